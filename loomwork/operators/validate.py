"""Rules to error lists: every rule is one expression; a row's errors come out as an array in the order of the rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.values import is_empty


def rule(field: str, **checks) -> list[Column]:
    """Error messages (null where the check holds). Checks: required, min_length, max_length, pattern, enum, minimum, maximum, multiple_of, min_items, max_items, unique_items."""
    c = F.col(field)
    say = lambda bad, what: F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{field}: {what}"))
    made = {
        "required": lambda v: say(is_empty(c) if v else F.lit(False), "required"),
        "min_length": lambda v: say(F.length(c) < v, f"shorter than {v}"),
        "max_length": lambda v: say(F.length(c) > v, f"longer than {v}"),
        "pattern": lambda v: say(~c.rlike(v), "pattern"),
        "enum": lambda v: say(~c.isin(list(v)), "not allowed"),
        "minimum": lambda v: say(c < v, f"below {v}"),
        "maximum": lambda v: say(c > v, f"above {v}"),
        "multiple_of": lambda v: say(c % v != 0, f"no multiple of {v}"),
        "min_items": lambda v: say(F.size(c) < v, f"fewer than {v} items"),
        "max_items": lambda v: say(F.size(c) > v, f"more than {v} items"),
        "unique_items": lambda v: say(F.size(c) != F.size(F.array_distinct(c)) if v else F.lit(False), "repeated items"),
    }
    return [made[k](v) for k, v in checks.items()]


def relation(kind: str, a: str, b: str) -> Column:
    """mutually_exclusive, mutually_required, greater_than, less_than or depends between two fields."""
    x, y = F.col(a), F.col(b)
    bad = {
        "mutually_exclusive": x.isNotNull() & y.isNotNull(),
        "mutually_required": x.isNull() != y.isNull(),
        "greater_than": ~(x > y),
        "less_than": ~(x < y),
        "depends": x.isNotNull() & y.isNull(),
    }[kind]
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{a} {kind} {b}"))


def errors(*rules: Column | list[Column]) -> Column:
    return F.array_compact(F.array(*[c for r in rules for c in (r if isinstance(r, list) else [r])]))


def coerce(field: Column, kind: str) -> Column:
    """The value as ``kind`` if it can be read so, else null."""
    return F.trim(field.cast("string")).try_cast({"integer": "bigint", "number": "double", "boolean": "boolean", "date": "date", "string": "string"}[kind])
