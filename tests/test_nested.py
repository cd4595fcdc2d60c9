import json

from loomwork.operators import nested


def rows(text, role="pipeline"):
    return sorted((k, p, f) for k, _, p, _, f, _ in nested.rows_of(nested.Automaton(), text, 1, role))


def state(value):
    auto = nested.Automaton()
    return auto.name(auto.run(value)[0])


def test_paths_and_links():
    inner = {"name": "b", "config": {"conditions": {"field": "x"}, "stages": json.dumps([{"name": "c"}])}}
    text = json.dumps({"stages": [{"name": "a", "config": json.dumps({"stages": [None, inner]})}, {"name": None}, "no stage"]})
    assert rows(text) == [("condition", "0.1.0", "x"), ("stage", "0", "a"), ("stage", "0.1", "b"), ("stage", "0.1.0", "c"), ("stage", "1", "")]
    parents = {p: q for _, _, p, q, _, _ in nested.rows_of(nested.Automaton(), text, 1, "pipeline")}
    assert parents["0.1.0"] == "0.1" and parents["0"] == ""


def test_broken_and_odd_texts():
    for text in (None, "", "{", '{"stages": [', "[]", "3", "NaN", '{"stages": NaN}', '{"stages": null}', '{"stages": 7}'):
        assert rows(text) == []
    assert rows('{"stages": {"name": 5}}') == [("stage", "0", "5")]
    assert rows('{"rollouts": {"a": null, "b": {"status": "ACTIVE"}, "c": "{\\"status\\": \\"x\\"}"}}', "snapshot") == [("rollout", "a", ""), ("rollout", "b", "ACTIVE"), ("rollout", "c", "x")]


def test_deep_nesting():
    node = {"name": "leaf"}
    for _ in range(200):
        node = {"name": "n", "config": {"stages": [node]}}
    assert len(rows(json.dumps({"stages": [node]}))) == 201


def test_tables(spark):
    a = spark.createDataFrame([(1, '{"stages": [{"name": "a", "type": "T"}]}', "z"), (1, '{"stages": [{"name": "a", "type": "T"}]}', "z"), (None, "{}", "z"), (2, None, "z")], "config_id bigint, config_json string, kind string")
    b = spark.createDataFrame([], "snapshot_id bigint, payload string")
    assert [tuple(r) for r in nested.found(a, b).collect()] == [("stage", 1, "0", "a")]
    assert nested.subtype(a, "config_id", "config_json", "pipeline", "stage").first().stage_type == "T"


def test_states_tell_shapes_apart_at_every_depth():
    deep = lambda leaf: {"name": "a", "config": {"stages": [{"name": "b", "config": {"stages": [{"name": "c", "config": leaf}]}}]}}
    assert state(deep({"x": 1})) != state(deep({"x": "1"})) and state(deep({"x": 1})) == state(deep({"x": 2.5}))
    assert state(deep({"x": 1, "y": None})) == state(deep({"y": None, "x": 7})) != state(deep({"y": 7, "x": None}))
    assert state({"c": json.dumps(deep({"x": 1}))}) == state({"c": deep({"x": 2})}) != state({"c": "plain"})
    assert state({"a:n,b": 1}) != state({"a": 1, "b": 1}) and state([1, 2]) == state([3]) != state([])
    node = {}
    for _ in range(5000):
        node = {"k": [node]}
    assert state(node)


def test_variants_of_both_tables(spark, data):
    from loomwork.queries.data import p2_variants

    assert {r.kind for r in p2_variants(spark, data).select("kind").distinct().collect()} == {"stage", "condition", "rollout"}


def test_rows_depend_on_states_only():
    """Objects of one state are routed alike; without the slots of its state a record gives nothing."""
    auto = nested.Automaton()
    a, b = (auto.run({"stages": [{"name": n, "config": {"conditions": [{"field": n, "value": 3}]}}]}) for n in "xy")
    assert a[0] == b[0] and auto.slots("pipeline", a[0]) == [(("stages",), "stage", "list")]
    auto.plans[("pipeline", a[0])] = []
    assert not list(nested.rows_of(auto, '{"stages": [{"name": "z", "config": {"conditions": [{"field": "z", "value": 3}]}}]}', 1, "pipeline"))


def test_typed_columns(spark):
    text = json.dumps({"stages": {"name": "s", "config": {"conditions": [{"field": "a", "value": 3}, {"field": "b", "value": True, "operator": "eq"}, {"field": "c", "value": "x"}, {"field": "d", "value": [1, "y"]}, {"value": None}]}}})
    df = spark.createDataFrame([(1, text)], "config_id bigint, config_json string")
    got = nested.subtype(df, "config_id", "config_json", "pipeline", "condition").orderBy("path").collect()
    assert [(r.found, r.operator, r.value_text, r.value_number, r.value_flag, r.value_list) for r in got] == [("a", None, None, 3.0, None, None), ("b", "eq", None, None, True, None), ("c", None, "x", None, None, None), ("d", None, None, None, None, '[1, "y"]'), ("", None, None, None, None, None)]
    assert len({r.state for r in got}) == 5 and {r.parent_path for r in got} == {"0"}
