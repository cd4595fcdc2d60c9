"""Deeply nested JSON records turned into related flat tables that keep their parent links.

A bottom-up tree automaton classifies every node of a record in one pass. A state stands for a shape: the kind of a
scalar, the set of states in a list, the keys of an object with the states of their values, or a string that holds JSON
of some state; equal shapes have one state at every depth. What is done with a node depends on its state alone:
``Automaton.slots`` says once per state and role which of its keys lead to child objects of which role, so that a
record is only descended where its states have such slots, and ``Automaton.variant`` says once per state which typed
columns of the role's subtype table its objects fill. All subtype tables share the supertype keys
``kind, rec_id, path, parent_path, found, state``.

Reading rules: a single object where a list is usual is a list of one, a string that holds JSON is that JSON, and
positions count from zero over the list as it stands (an element that is no object keeps its position but has no row).
Texts that are null, cut off or no valid JSON have no rows; NaN and Infinity are no JSON. Rows delivered twice come
out twice here and once in ``found``. A row without an id has no rows.
"""

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: role -> (list of (key path, role of the children, whether they sit in a map), key whose value identifies the object)
ROLES = {
    "pipeline": ([(("stages",), "stage", False)], "name"),
    "stage": ([(("config", "stages"), "stage", False), (("config", "conditions"), "condition", False)], "name"),
    "condition": ([], "field"),
    "snapshot": ([(("rollouts",), "rollout", True)], "saved_by"),
    "rollout": ([], "status"),
}
#: role -> (column, key path, type) of its subtype table; a value of another type leaves the column null.
COLUMNS = {
    "stage": [("stage_type", ("type",), "s"), ("min_confidence", ("config", "min_confidence"), "n"), ("max_items", ("config", "max_items"), "n"), ("output_field", ("config", "output_field"), "s"), ("formats", ("config", "formats"), "s"), ("has_config", ("config",), "o")],
    "condition": [("operator", ("operator",), "s"), ("next_stage", ("next_stage",), "s"), ("value_text", ("value",), "s"), ("value_number", ("value",), "n"), ("value_flag", ("value",), "b"), ("value_list", ("value",), "l")],
    "rollout": [("feature_name", ("feature_name",), "s"), ("current_phase", ("current_phase",), "s"), ("has_config", ("config",), "o")],
}
ARROW = {"s": pa.string(), "n": pa.float64(), "b": pa.bool_(), "l": pa.string(), "o": pa.bool_()}
SQL = {"s": "string", "n": "double", "b": "boolean", "l": "string", "o": "boolean"}
KEYS = [("kind", pa.string()), ("rec_id", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()), ("found", pa.string()), ("state", pa.string())]
SCHEMA = "kind string, rec_id bigint, path string, parent_path string, found string, state string"


def _reject(token: str):
    raise ValueError(token)


def _load(text: str):
    return json.loads(text, parse_constant=_reject)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


class Automaton:
    """States are numbers; a node is (state, children or scalar). One automaton serves a task, its states are bounded by the shapes the task meets."""

    LIMIT = 200_000

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known: dict[tuple, int] = {}
        self.shapes: list[tuple] = []
        self.names: dict[int, str] = {}
        self.plans: dict[tuple[str, int], list] = {}
        self.fills: dict[tuple[str, int], list] = {}

    def _state(self, shape: tuple) -> int:
        at = self.known.get(shape)
        if at is None:
            at = self.known[shape] = len(self.shapes)
            self.shapes.append(shape)
        return at

    def run(self, value) -> tuple[int, object]:
        """The annotated tree of a value, made bottom-up without recursion of our own."""
        done: list[tuple[int, object]] = []
        todo: list[tuple[object, int]] = [(value, 0)]
        while todo:
            node, ready = todo.pop()
            kind = type(node)
            if ready == 2:  # a string whose JSON is done
                state, inner = done.pop()
                done.append((self._state(("j", state)), (state, inner)))
            elif kind is dict:
                if not ready:
                    todo.append((node, 1))
                    todo.extend((x, 0) for x in node.values())
                else:
                    own = dict(zip(node, done[len(done) - len(node) :][::-1], strict=True)) if node else {}
                    del done[len(done) - len(node) :]
                    done.append((self._state(("o", *sorted((k, v[0]) for k, v in own.items()))), own))
            elif kind is list:
                if not ready:
                    todo.append((node, 1))
                    todo.extend((x, 0) for x in node)
                else:
                    items = done[len(done) - len(node) :][::-1] if node else []
                    del done[len(done) - len(node) :]
                    done.append((self._state(("l", *sorted({v[0] for v in items}))), items))
            elif kind is str and node.lstrip()[:1] in ("{", "[", '"'):
                try:
                    inner = _load(node)
                except (ValueError, RecursionError):
                    done.append((self._state(("s",)), node))
                else:
                    todo.append((node, 2))
                    todo.append((inner, 0))
            else:
                done.append((self._state(("z",) if node is None else ("b",) if kind is bool else ("s",) if kind is str else ("n",)), node))
        return done[0]

    def seen(self, node: tuple[int, object]) -> tuple[int, object]:
        """The node that a string holding JSON stands for, else the node itself."""
        while self.shapes[node[0]][0] == "j":
            node = node[1]
        return node

    def _seen_state(self, state: int) -> int:
        while self.shapes[state][0] == "j":
            state = self.shapes[state][1]
        return state

    def _follow(self, state: int, keys: tuple[str, ...]) -> int | None:
        """The state below a key path, by the states alone."""
        for key in keys:
            shape = self.shapes[self._seen_state(state)]
            below = dict(shape[1:]) if shape[0] == "o" else {}
            if key not in below:
                return None
            state = below[key]
        return self._seen_state(state)

    def slots(self, role: str, state: int) -> list[tuple[tuple[str, ...], str, str]]:
        """(key path, role of the children, 'map', 'list' or 'one') of a state's keys that lead to child objects."""
        plan = self.plans.get((role, state))
        if plan is None:
            plan = []
            for keys, child, in_map in ROLES[role][0]:
                below = self._follow(state, keys)
                shape = self.shapes[below] if below is not None else ("z",)
                if in_map and shape[0] == "o" and len(shape) > 1:
                    plan.append((keys, child, "map"))
                elif not in_map and shape[0] == "o":
                    plan.append((keys, child, "one"))
                elif not in_map and shape[0] == "l" and any(self.shapes[self._seen_state(x)][0] == "o" for x in shape[1:]):
                    plan.append((keys, child, "list"))
            self.plans[role, state] = plan
        return plan

    def variant(self, role: str, state: int) -> list[tuple[int, tuple[str, ...], str]]:
        """(position of the column, key path, type) of the subtype columns that objects of a state fill."""
        fills = self.fills.get((role, state))
        if fills is None:
            fills = []
            for k, (_, keys, kind) in enumerate(COLUMNS[role]):
                below = self._follow(state, keys)
                if below is not None and self.shapes[below][0] == kind:
                    fills.append((k, keys, kind))
            self.fills[role, state] = fills
        return fills

    def name(self, state: int) -> str:
        """A state's name, the same in every task: a digest of its whole shape."""
        todo = [state]
        while todo:
            at = todo[-1]
            shape = self.shapes[at]
            below = [x[1] for x in shape[1:]] if shape[0] == "o" else shape[1:]
            missing = [x for x in below if x not in self.names]
            if at in self.names or not missing:
                todo.pop()
                if shape[0] == "j":
                    self.names[at] = self.names[shape[1]]
                elif at not in self.names:
                    told = [shape[0], *[[k, self.names[x]] for k, x in shape[1:]]] if shape[0] == "o" else [shape[0], *sorted({self.names[x] for x in shape[1:]})]
                    self.names[at] = hashlib.md5(json.dumps(told).encode("utf-8", "surrogatepass")).hexdigest()
            else:
                todo.extend(missing)
        return self.names[state]

    def under(self, node: tuple[int, object], keys: tuple[str, ...]) -> tuple[int, object]:
        node = self.seen(node)
        for key in keys:
            node = self.seen(node[1][key])
        return node


def _plain(auto: Automaton, node: tuple[int, object]):
    """The value of an annotated node."""
    node = auto.seen(node)
    kind = auto.shapes[node[0]][0]
    return {k: _plain(auto, v) for k, v in node[1].items()} if kind == "o" else [_plain(auto, v) for v in node[1]] if kind == "l" else node[1]


def rows_of(auto: Automaton, text: str | None, rec_id: int, role: str, typed: str | None = None) -> Iterator[tuple]:
    """The flat rows of one record; with ``typed``, only those of that kind, followed by its typed columns."""
    if text is None:
        return
    try:
        root = auto.seen(auto.run(_load(text)))
    except (ValueError, RecursionError):
        return
    if auto.shapes[root[0]][0] != "o":
        return
    todo = [(root, role, "")]
    while todo:
        node, own, path = todo.pop()
        for keys, child_role, how in auto.slots(own, node[0]):
            below = auto.under(node, keys)
            pairs = below[1].items() if how == "map" else [("0", below)] if how == "one" else enumerate(below[1])
            label = ROLES[child_role][1]
            for step, child in pairs:
                child = auto.seen(child)
                whole = auto.shapes[child[0]][0] == "o"
                if not whole and how != "map":
                    continue
                at = f"{path}.{step}" if path else str(step)
                if typed is None or typed == child_role:
                    found = _text(_plain(auto, child[1][label])) if whole and label in child[1] else ""
                    row = [child_role, rec_id, at, path, found, auto.name(child[0])]
                    if typed:
                        cells: list = [None] * len(COLUMNS[child_role])
                        for k, column_keys, kind in auto.variant(child_role, child[0]):
                            value = auto.under(child, column_keys)
                            cells[k] = True if kind == "o" else float(value[1]) if kind == "n" else json.dumps(_plain(auto, value), ensure_ascii=False) if kind == "l" else value[1]
                        row += cells
                    yield tuple(row)
                if whole:
                    todo.append((child, child_role, at))


def flatten(df: DataFrame, rec_id: str, text: str, role: str, typed: str | None = None) -> DataFrame:
    """All rows below the records of ``df`` in their supertype form, or the typed subtype table of one kind."""
    extra = COLUMNS[typed] if typed else []
    names = [n for n, _ in KEYS] + [n for n, *_ in extra]
    kinds = [t for _, t in KEYS] + [ARROW[k] for _, _, k in extra]
    schema = ", ".join([SCHEMA, *[f"{n} {SQL[k]}" for n, _, k in extra]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = [r for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in rows_of(auto, t, i, role, typed)]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
                if len(auto.shapes) > Automaton.LIMIT:
                    auto.forget()

    return df.select(F.col(rec_id).cast("bigint").alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null and i is not null").mapInArrow(run, schema)


def subtype(df: DataFrame, rec_id: str, text: str, role: str, kind: str) -> DataFrame:
    """The typed table of one kind: supertype keys, the parent link and the columns proper to the kind."""
    return flatten(df, rec_id, text, role, kind).drop("kind")


def variants(flat: DataFrame) -> DataFrame:
    """(kind, state, n_rows, n_records): the structural variants of each role and how often they occur."""
    return flat.groupBy("kind", "state").agg(F.count("*").alias("n_rows"), F.count_distinct("rec_id").alias("n_records"))


def found(configs: DataFrame, rollouts: DataFrame) -> DataFrame:
    """(kind, rec_id, path, found): stages and conditions of config_json, rollouts of payload."""
    both = flatten(configs, "config_id", "config_json", "pipeline").unionByName(flatten(rollouts, "snapshot_id", "payload", "snapshot"))
    return both.select("kind", "rec_id", "path", "found").distinct()
