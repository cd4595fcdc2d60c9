"""Similar rows, groups, rules, ranks and name parts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomwork.functions import parties
from loomwork.operators import dedup, metrics, similar
from loomwork.operators.rules import RuleSet


def sets_of(texts):
    return {i: frozenset(t.lower().split()) for i, t in texts if t and t.split()}


def test_pairs_and_groups_against_brute_force(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    texts = [(i, " ".join(r.sample(words, r.randrange(3, 9)))) for i in range(150)]
    texts += [(200 + i, t + " " + r.choice(words)) for i, t in texts[:60]] + [(400, None), (401, ""), (402, "   "), (403, texts[0][1]), (403, texts[0][1])]
    df = spark.createDataFrame([(*t, "a", "b") for t in texts], "id bigint, t string, words string, rep string")
    for threshold in (0.8, 0.6):
        one = similar.WordSets(df, "id", F.col("t"), threshold)
        sets = sets_of(texts)
        reps = {}
        for i in sorted(sets):
            reps.setdefault(sets[i], i)
        want = {(min(a, b), max(a, b)) for x, a in reps.items() for y, b in reps.items() if a != b and len(x & y) / len(x | y) >= threshold}
        assert {(p.rep_a, p.rep_b) for p in one.pairs().collect()} == want and want
        parent = {i: i for i in reps.values()}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in want:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        got = {g.row_id: g for g in one.groups().collect()}
        assert {i: g.group_id for i, g in got.items()} == {i: root(reps[s]) for i, s in sets.items()}
        assert all(g.n_links == sum(g.class_id in p for p in want) for g in got.values())
    assert similar.WordSets(df.limit(0), "id", F.col("t"), 0.8).groups().count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = dict(map(tuple, similar.components(edges).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_weights_of_missing_fields_are_shared_out(spark):
    df = spark.createDataFrame([("a b", "a b", "x", None), ("a b", "a c", "x", "x"), (None, "a", None, "x")], "a string, b string, c string, d string")
    s = similar.weighted({"p": (0.6, F.col("a"), F.col("b")), "q": (0.4, F.col("c"), F.col("d"))})
    got = df.select(s.alias("s"), similar.label(s).alias("l")).collect()
    assert [r.s for r in got] == [1.0, pytest.approx(0.6), None] and [r.l for r in got] == ["exact", "partial", None]


def test_rules_and_null_columns(spark):
    rules = RuleSet().add("low", 1, t="a").add("high", 2, t="a", u="b").add("any", 3, any_of=True, t="z", u="z")
    df = spark.createDataFrame([("a", "b"), ("a", None), ("q", "z"), (None, None)], "t string, u string")
    assert [tuple(r) for r in df.select(rules.first(), rules.every()).collect()] == [("high", ["high", "low"]), ("low", ["low"]), ("any", ["any"]), (None, [])]


def test_value_at_against_sorting(spark):
    r = random.Random(1)
    rows = [(r.choice(["x", "y", None]), r.choice([None, 1.0, 1.0, r.random() * 1e6, -r.random()])) for _ in range(4000)] + [("z", 5.0), ("w", None)]
    got = {x.g: (x.at, x.n) for x in metrics.value_at(spark.createDataFrame(rows, "g string, v double"), "g", "v", lambda n: F.floor(n / 2) + 1, 8).collect()}
    own = {g: sorted(v for h, v in rows if h == g and v is not None) for g in ("x", "y", "z", None)}
    assert got == {g: (v[len(v) // 2], len(v)) for g, v in own.items()}


def test_rows_without_a_key_are_no_duplicates(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "i bigint, k string")
    assert sorted(r.i for r in dedup.first_by(df, ["k"], [F.col("i")]).collect()) == [1, 2, 3]


@pytest.mark.parametrize(("name", "want"), [
    ("Dr. Ada B. Lovelace Jr.", ("Dr", "Ada", "B.", "Lovelace", "Jr")), ("Lovelace, Ada", (None, "Ada", None, "Lovelace", None)), ("Ada", (None, "Ada", None, None, None)), (None, (None,) * 5),
])
def test_name_parts(spark, name, want):
    assert tuple(spark.createDataFrame([(name,)], "n string").select(parties.name_parts(F.col("n")).alias("x")).select("x.*").first()) == want


@pytest.mark.parametrize(("text", "kind"), [
    ("123e4567-e89b-12d3-a456-426614174000", "uuid"), ("978-3-16-148410-0", "isbn13"), ("0-306-40615-2", "isbn10"), ("4006381333931", "ean"), ("a@b.example", "email"), ("https://a.example/x", "url"), ("978-3-16-148410-1", "other"), ("", "other"), (None, None),
])
def test_identifier_kinds(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(parties.identifier_kind(F.col("t"))).first()[0] == kind


def test_address_parts(spark):
    got = spark.createDataFrame([("12 Oak Rd, Dale, tx 75001",), ("nowhere",), (None,)], "t string").select(parties.address_parts(F.col("t")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("12 Oak Rd", "Dale", "TX", "75001"), (None,) * 4, (None,) * 4]


def test_candidates_do_not_grow_with_rows_a_word(spark):
    # 4,000 titles over 60 words: each word is a rare one of hundreds of titles.
    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    df = spark.createDataFrame([(i, " ".join(r.sample(words, 7))) for i in range(4000)] + [(9000, "a b c d e f g"), (9001, "a b c d e f g h")], "i bigint, t string")
    one = similar.WordSets(df, "i", F.col("t"), 0.8)
    assert one.candidates().count() == one.pairs().count() >= 1


@pytest.mark.parametrize("threshold", [1.0, 0.9, 0.8, 0.75, 0.5, 0.2])
def test_pairs_of_short_and_long_texts_against_brute_force(spark, threshold):
    r = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    sets = {frozenset(r.sample(words, n)) for n in range(1, 31) for _ in range(3)}
    sets |= {frozenset([*s][: r.randrange(1, len(s) + 1)] + r.sample(words, r.randrange(3))) for s in [*sets] for _ in range(3)}
    own = dict(enumerate(sorted(sets, key=sorted)))
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in own.items()], "i bigint, t string")
    want = {(a, b) for a, x in own.items() for b, y in own.items() if a < b and len(x & y) / len(x | y) >= threshold - 1e-9}
    assert {(p.rep_a, p.rep_b) for p in similar.WordSets(df, "i", F.col("t"), threshold).pairs().collect()} == want


def test_subsets_that_no_whole_set_meets_are_not_sent(spark):
    # Each of 3,000 titles has eight keys; only its whole set and what meets another is sent.
    r = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    df = spark.createDataFrame([(i, " ".join(r.sample(words, 7))) for i in range(3000)] + [(9000, "a b c d e f g"), (9001, "a b c d e f g h")], "i bigint, t string")
    one = similar.WordSets(df, "i", F.col("t"), 0.8)
    assert 3000 < one._keys(one._sized(), similar._subsets(0.8)).count() < 2 * 3000
    assert [tuple(p) for p in one.pairs().collect()] == [(9000, 9001, 7 / 8)]


@pytest.mark.parametrize("few", [0, 5, 1 << 20])
def test_pairs_are_the_same_whether_classes_are_few_or_many(spark, monkeypatch, few):
    monkeypatch.setattr(similar, "FEW", few)
    texts = ["a b c d e", "a b c d e f", "E d c b a", "x y", "y X", "p q r s t u v w", "p q r s t u v w z", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "p q r s t u v w k"), (None, "x y")]
    got = similar.WordSets(spark.createDataFrame(rows, "i bigint, t string"), "i", F.col("t"), 0.8).pairs().collect()
    assert sorted((p.rep_a, p.rep_b, round(p.similarity, 6)) for p in got) == [(0, 1, 0.833333), (0, 5, 0.888889), (0, 6, 0.8), (5, 6, 0.888889)]


def test_all_uses_of_the_classes_share_one_shuffle(spark):
    df = spark.createDataFrame([(1, "a b c")], "i bigint, t string")
    plan = similar.WordSets(df, "i", F.col("t"), 0.8).candidates()._jdf.queryExecution().optimizedPlan().toString()
    assert len({re.sub(r"#\d+L?", "", x.lstrip(" :+-")) for x in plan.splitlines() if "Filter" in x and "array_join" in x}) == 1


def test_narrowed_keeps_all_rows_of_the_ids_without_moving_them(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "i bigint, t string")
    ids = spark.createDataFrame([(1,), (7,)], "rep bigint")
    one = similar.narrowed(df, "i", ids)
    assert sorted(r.t for r in one.collect()) == ["a", "b"] and "Exchange hashpartitioning" not in one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(similar, "FEW", 1)
    assert similar.narrowed(df, "i", ids).count() == 4
