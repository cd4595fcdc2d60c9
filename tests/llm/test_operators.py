"""Brute force, edge cases and held-out accuracy of the training-data operators."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import boilerplate, leakage, lines, mixing, products, refine, residue, spans

RNG = random.Random(5)
WORDS = [a + b for a in "ba ko ti mu re".split() for b in "lan sor dek vim pul".split()]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


# ---- refine ----------------------------------------------------------------------------------------------------

HIT = "hit_id bigint, title string, snippet string, url string, metadata string, _id string, first_id string"


def copies(spark, rows):
    got = refine.refine(spark.createDataFrame([(*r, "a", "b") for r in rows], HIT), "hit_id", ["title", "snippet"], ["url"], ["metadata"])
    return sorted((r.row_id, r.first_id, r.n_copies) for r in got.collect())


def test_refine_formats_and_nulls(spark):
    rows = [
        (1, "A b", None, "http://x/?a=1&b=2", '{"k": 1, "l": "z"}'), (2, " a-B!", None, "HTTP://X?b=2&a=1", '{"l":"Z","k":1}'), (3, "a b", "", "http://x/?a=1&b=2", '{"k": 1, "l": "z"}'),
        (4, "ba", None, "http://x/?a=1&b=2", '{"k": 1, "l": "z"}'), (5, None, None, None, None), (6, None, None, None, None), (6, None, None, None, None), (7, "x", "Straße", "u", "no json"), (8, "X", "STRASSE", "u", "No JSON"),
        (None, "A b", None, "http://x/?a=1&b=2", '{"k": 1, "l": "z"}'), (9, "a b", None, "http://x/?a=1&b=2&c=3", '{"k": 1, "l": "z"}'),
    ]
    assert copies(spark, rows) == [(1, 1, 2), (2, 1, 2), (5, 5, 2), (6, 5, 2), (7, 7, 2), (8, 7, 2)]
    assert copies(spark, []) == []


def test_refine_hot_class_and_long_text(spark):
    rows = [(i, "Same, title", "x" * 100_000, f"http://h/{i % 2}", "{}") for i in range(60)]
    got = copies(spark, rows)
    assert len(got) == 60 and {f for _, f, _ in got} == {0, 1} and {n for *_, n in got} == {30}


def test_records_of_both_tables_with_their_copies(spark):
    hits = spark.createDataFrame([(1, "A b", "s", "http://x/", "{}", "d"), (2, "a-b", "S", "http://x/", "{}", "e"), (3, "c", None, "u", None, None)], "hit_id bigint, title string, snippet string, url string, metadata string, domain string")
    brokers = spark.createDataFrame([(1, "A", "9", "Full text", "v"), (4, "a", "9", "full  TEXT", "V"), (5, None, None, None, None)], "result_id bigint, title string, price string, full_text string, detail_url string")
    got = refine.records({"search_results": hits, "broker_results": brokers}).collect()
    assert sorted((r.src_table, r.rec_id, r.n_copies, r.title, r.domain, r.full_text) for r in got if r.rec_id == 1) == [("broker_results", 1, 2, "A", None, "Full text"), ("search_results", 1, 2, "A b", "d", None)]
    assert sorted((r.src_table, r.rec_id, r.n_copies) for r in got if r.rec_id > 1) == [("broker_results", 5, 1), ("search_results", 3, 1)]


# ---- lines -----------------------------------------------------------------------------------------------------

def test_lines(spark):
    pages = [(i, f"https://www.Site.example/{i}", f"Menu {i}\n\nown {prose(3)} {chr(97 + i)}\n ALL rights reserved", "extra") for i in range(6)]
    pages += [(10, "http://site.example:80/x", "all RIGHTSreserved\n", "e"), (10, "http://site.example:80/x", "all RIGHTSreserved\n", "e"), (11, "http://other.example", "Menu 1", "e"), (12, None, "Menu 1", "e"), (13, "http://site.example", None, "e"), (14, "http://site.example", "", "e")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, main_content string, site string")
    found = lines.standing_lines(df)
    got = sorted(map(tuple, found.collect()))
    assert got == sorted([(i, 1) for i in range(6)] + [(i, 4) for i in range(6)] + [(10, 1)])
    rest = {r.page_id: r.main_content for r in lines.without(df.dropDuplicates(["page_id"]), found).collect()}
    assert rest[0].startswith("\nown") and rest[10] == "" and rest[13] is None and rest[14] == ""
    assert lines.standing_lines(df.limit(0)).count() == 0


def test_tree_is_opened_level_by_level(spark):
    # Six pages share a leaf; others agree with it in length only, or in length and leading token only.
    texts = [f"abcdef {w} uvwxyz" for w in ("one", "one", "one", "one", "one", "one")] + ["abcdef two nopqrs", "abcdef six hijklm", "ghijkl one uvwxyz", "short"]
    df = spark.createDataFrame([(i, "http://a.example/", t) for i, t in enumerate(texts)] + [(99, "http://b.example/", texts[0])], "page_id bigint, url string, main_content string")
    trees = lines.tree_lines(df, "page_id", "url", "main_content").groupBy("path", "leaf", "salt").agg(F.count("*").alias("n"))
    kept = [x.agg(F.sum("n")).first()[0] for x in lines.levels(trees, 6)]
    assert kept == [9, 8, 6, 6]
    found = lines.standing_lines(df)
    assert sorted(map(tuple, found.collect())) == [(i, 1) for i in range(6)]
    # Both uses of the lines read one shuffle.
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [1, 2, 6])
def test_standing_lines_against_brute_force(spark, least):
    r = random.Random(least)
    pages = [(i, f"http://{r.choice('abc')}.example/{i}", "\n".join(r.choice(["Menu", "menu 2", "me nu", "Imprint", "About us", "abcdef g uvwxyz", "abcdef h uvwxyz", "", " ", f"own {chr(97 + i % 26)}{i}"]) for _ in range(r.randrange(8)))) for i in range(80)]
    seen = defaultdict(set)
    where = []
    for i, url, text in pages:
        for k, line in enumerate(text.split("\n"), 1):
            if line.strip():
                key = (url.split("/")[2], re.sub(r"[\s\d]", "", line).lower())
                seen[key].add(i)
                where.append((i, k, key))
    want = sorted((i, k) for i, k, key in where if len(seen[key]) >= least)
    df = spark.createDataFrame(pages, "page_id bigint, url string, main_content string")
    assert sorted(map(tuple, lines.standing_lines(df, least_pages=least).collect())) == want


# ---- leakage ---------------------------------------------------------------------------------------------------

def test_leakage_against_brute_force(spark):
    items = [(i, prose(20)) for i in range(10)] + [(90, None), (91, ""), (92, prose(5))]
    docs = []
    for i in range(60):
        text = prose(40)
        if i % 3 == 0:
            words = RNG.choice(items[:10])[1].split()
            k = RNG.choice([12, 13, 15])
            text += ". " + " - ".join(words[2 : 2 + k]).upper() + "! " + prose(5)
        docs.append((i, text, "x"))
    docs += [(100, None, "x"), (101, "", "x"), (0, docs[0][1], "x"), (102, prose(60_000), "x")]
    got = {tuple(r) for r in leakage.found(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for k in range(len(w) - 12):
            windows[tuple(w[k : k + 13])].add(i)
    want = set()
    for d, t, _ in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        want |= {(i, d) for k in range(len(w) - 12) for i in windows.get(tuple(w[k : k + 13]), ())}
    assert got == want and want


def test_leakage_finds_new_parameters(spark):
    item = "the robot Zicholl visits 369 links per hour while the robot Greltitt visits 528 links per hour until Zicholl rests"
    changed = "the robot Anton visits 12 links per hour while the robot Berta visits 99 links per hour until Anton rests"
    mixed = "the robot Anton visits 12 links per hour while the robot Anton visits 12 links per hour until Berta rests"
    docs = spark.createDataFrame([(1, changed), (2, mixed), (3, item.lower())], "doc_id bigint, text string")
    got = {(r.doc_id, r.kind) for r in leakage.leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert (1, "re-parameterised") in got and (3, "verbatim") in got and not any(k == "verbatim" for d, k in got if d == 2)
    assert leakage.leaks(docs.limit(0), spark.createDataFrame([(7, item)], "item_id bigint, text string")).count() == 0
    assert leakage.leaks(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


# ---- mixing ----------------------------------------------------------------------------------------------------

def test_sainte_lague_equals_the_sequence_of_quotients():
    for seed in range(30):
        r = random.Random(seed)
        shares = [r.random() for _ in range(r.randrange(1, 6))]
        caps = [r.randrange(0, 30) for _ in shares]
        want = [0] * len(shares)
        for _ in range(40):
            open_ = [k for k in range(len(shares)) if want[k] < caps[k]]
            if not open_:
                break
            best = max(open_, key=lambda k: (shares[k] / (2 * want[k] + 1), -k))
            want[best] += 1
        assert mixing.sainte_lague(shares, caps, 40) == want
    assert mixing.sainte_lague([], [], 5) == [] and mixing.sainte_lague([0.0, 1.0], [5, 2], 9) == [0, 2]


def test_mixing(spark):
    docs = [(i, "a" if i % 3 else "b", prose(200)) for i in range(90)] + [(200, "b", None), (201, None, "x"), (202, "unlisted", prose(50)), (203, "a", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2), ("c", 0.0, 5)], "source string, target_share double, max_repeats int")
    rows = {r.source: r for r in mixing.shares(df, targets, block_tokens=64).collect()}
    assert rows["a"].reachable and not rows["b"].reachable and rows["c"].tokens == 0 and rows["b"].passes <= 2
    assert sum(r.actual_share for r in rows.values()) == pytest.approx(1)
    assert [r.source for r in mixing.found(df, targets).collect()] == ["b"]
    counts = mixing.token_counts(df).cache()
    chosen = mixing.selected(counts, targets, block_tokens=64).collect()
    again = mixing.selected(counts.repartition(3), targets, block_tokens=64).collect()
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, again)) and {r.source for r in chosen} == {"a", "b"}
    for s in "ab":
        placed = sum(r.n_tokens * r.copies for r in chosen if r.source == s)
        assert rows[s].mix_tokens == placed and abs(placed - 64 * rows[s].blocks) < 1500
    assert mixing.shares(df.limit(0), targets).count() == 3


def test_mixing_follows_the_quotas_of_many_shards(spark, monkeypatch):
    """Reachability by quotas is what the definition says, and every shard gives its quota."""
    r = random.Random(9)
    for name in ("SHARD_TOKENS", "MAX_SHARDS"):
        monkeypatch.setattr(mixing, name, 20_000 if name == "SHARD_TOKENS" else 50)
    rows = [(i, r.choice("aaaaaabcde"), r.randrange(1, 400)) for i in range(6000)]
    counts = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    tokens = {s: sum(n for _, x, n in rows if x == s) for s in "abcde"}
    total = sum(tokens.values())
    shares = {"a": 0.1, "b": 0.3, "c": 0.35, "d": 0.05, "e": 0.2}
    targets = spark.createDataFrame([(s, p, 1 + k % 3) for k, (s, p) in enumerate(shares.items())], "source string, target_share double, max_repeats int")
    planned = {x["source"]: x for x in mixing.plan(counts, targets, 64)}
    assert {s: x["reachable"] for s, x in planned.items()} == {s: (1 + k % 3) * tokens[s] >= p * total for k, (s, p) in enumerate(shares.items())}
    chosen = mixing.selected(counts, targets, 64).collect()
    for s, x in planned.items():
        assert max((c.copies for c in chosen if c.source == s), default=0) <= x["max_repeats"]
        assert sum(c.n_tokens * c.copies for c in chosen if c.source == s) == pytest.approx(64 * x["blocks"], rel=0.05)


# ---- spans -----------------------------------------------------------------------------------------------------

def shared_run(a, b, n):
    grams = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in grams for i in range(len(b) - n + 1))


def test_spans_against_brute_force(spark):
    passages = ["".join(RNG.choice("abcdefgh ä\U0001f600") for _ in range(n)) for n in (299, 300, 301, 700)]
    docs = []
    for i in range(40):
        parts = ["".join(RNG.choice("abcdefgh ä\U0001f600") for _ in range(RNG.randrange(0, 200)))]
        for p in passages:
            if RNG.random() < 0.3:
                parts += [p, "".join(RNG.choice("xyz") for _ in range(RNG.randrange(0, 40)))]
        docs.append((i, "".join(parts)))
    docs += [(100, None), (101, ""), (102, docs[0][1] + passages[1]), (103, docs[0][1] + passages[1]), (103, docs[0][1] + passages[1]), (104, "q" * 100_000), (105, "q" * 350)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = spans.Spans(df)
    got = {tuple(r) for r in found.found().collect()}
    texts = {i: t for i, t in docs if t}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if shared_run(texts[a], texts[b], 300)}
    assert got == want and len(want) > 20
    cover = {r.doc_id: r for r in found.coverage().collect()}
    assert set(cover) == {x for p in want for x in p}
    for i, r in cover.items():
        mine, mark = texts[i], np.zeros(len(texts[i]), dtype=bool)
        others = {t[k : k + 300] for j, t in texts.items() if j != i and len(t) < 50_000 for k in range(len(t) - 299)}
        for k in range(len(mine) - 299):
            if mine[k : k + 300] in others:
                mark[k : k + 300] = True
        if i not in (104, 105):
            assert r.shared_chars == mark.sum(), i
    assert spans.found(df.limit(0)).count() == 0


def test_a_passage_in_ever_new_surroundings_costs_no_pairs(spark):
    """A passage below the length in many texts is indexed once per text; no window of it is shared."""
    line = "".join(RNG.choice("abcdefgh") for _ in range(290))
    make = lambda n: spark.createDataFrame([(i, f"{RNG.random()}" * 12 + line + f"{RNG.random()}" * 12) for i in range(n)], "doc_id bigint, text string")
    sizes = []
    for n in (200, 800):
        one = spans.Spans(make(n))
        assert one.found().count() == 0 and one.coverage().count() == 0
        sizes.append(one.windows.count())
    assert all(size < 2 * spans.BIN * n for n, size in zip((200, 800), sizes, strict=True))


def test_factors_point_to_equal_text(spark):
    docs = [(i, prose(30) + "|" + line + "|" + prose(30)) for i, line in enumerate([prose(90), *([prose(80)] * 5), prose(90)])]
    docs += [(9, docs[0][1][20:900] + "//" + docs[3][1])]
    texts = dict(docs)
    got = spans.Spans(spark.createDataFrame(docs, "doc_id bigint, text string")).factors().collect()
    assert got
    for r in got:
        mine, there = texts[r.rep][r.start : r.start + r["size"]], texts[r.ref][r.ref_start : r.ref_start + r["size"]]
        assert mine == there and len(mine) >= 300 and r.rep != r.ref


# ---- products --------------------------------------------------------------------------------------------------

ITEM = "item_id bigint, title string, brand string, features array<string>, code string, names string"


def grouped(spark, rows):
    return sorted(tuple(r) for r in products.found(spark.createDataFrame([(*r, "c", "n") for r in rows], ITEM)).collect())


def test_products(spark):
    rows = [
        (1, "Skoathke Noato GED 2820 Drill driver 24V 2 Ah", "Skoathke", ["Gift wrap available"]), (2, "BEST PRICE! CORDLESS DRILL, NOATO, GED-2820", "Skoathke GmbH", ["24-Volt", "2000mAh"]), (3, "Skaothke Noaato ged2820 drill 24 volt 2.0Ah", None, None),
        (4, "Skoathke Noato GED 2820 Drill driver 18V 2 Ah", "Skoathke", []), (5, "Carry case for Skoathke Noato GED 2820", "Skoathke", None), (6, None, None, None), (7, "No code here", "x", [None]), (2, "BEST PRICE! CORDLESS DRILL, NOATO, GED-2820", "Skoathke GmbH", ["24-Volt", "2000mAh"]),
        (8, "Wairkttroa Cilkioth GED 2820 drill 24V 2Ah", "Wairktroa", None), (9, "Grimho Fad LEC3560 laptop 15 in SSD 512GB RAM 8GB black", "Grimho", None), (10, "Grimho Fad lec 3560 notebook PC", "Grimho", ["8192MB RAM", "0.5TB SSD", "38.1 cm", "jet black"]), (None, "Grimho Fad lec 3560", "Grimho", None),
    ]
    assert grouped(spark, rows) == [(1, 2), (1, 3), (2, 3), (9, 10)]
    assert grouped(spark, []) == [] and grouped(spark, rows[5:7]) == []


@pytest.mark.parametrize(("title", "code"), [
    ("Bosch GSR 18V-55 cordless drill", "GSR18V55"), ("Dell XPS 13 laptop", "XPS13"), ("Canon EOS R6 body", "R6"), ("iPhone 15 black 128GB SSD", "IPHONE15"), ("LG 27GP850-B monitor 27 inch", "27GP850B"), ("Lenovo T14s notebook", "T14S"),
    ("Sony WH-1000XM3 headphones black", "WH1000XM3"), ("Sony WH-1000XM4 headphones black", "WH1000XM4"), ("Noato GED-2820 Drill 24V", "GED2820"), ("Noato drill 24V 2 Ah", None), ("Water bottle 500 ml blue", None),
])
def test_codes_of_many_shapes(title, code):
    got = products.parse(title, None, None)
    assert (got[0] if got else None) == code


def test_products_clusters_against_brute_force():
    """Blocks with many classes: what windows and pivots give is what comparing every class with every pivot gives."""
    r = random.Random(6)
    for _ in range(20):
        base = [w + "qr" for w in r.sample(WORDS, 4)]
        def slip(w):
            k = r.randrange(len(w))
            return w[:k] + r.choice(["", "x", w[k] * 2]) + w[k + 1 :] if r.random() < 0.5 else w

        names = {" ".join(sorted(slip(w) for w in r.sample(base, r.randrange(1, 4)))) for _ in range(60)}
        rows = [(products.letters_key(n), n, r.randrange(1, 9), i) for i, n in enumerate(sorted(names))]
        block, wide = products.Block(), products.Block()
        for row in rows:
            block.add(*row)
            wide.add(*row)
        got = sorted(block.clusters())
        before, products.WINDOW = products.WINDOW, 10_000
        assert sorted(wide.clusters()) == got
        products.WINDOW = before


def test_products_window_meets_partition_borders(spark):
    rows = [(i, f"Brando{'n' * (i % 2)} Serieso ABC{1000 + i // 4} drill 18V 2Ah", None, None) for i in range(400)]
    want = [(a, b) for k in range(0, 400, 4) for a, b in itertools.combinations(range(k, k + 4), 2)]
    assert grouped(spark, rows) == want


def test_products_with_more_spellings_than_any_window(spark):
    double = lambda w: [w[: i + 1] + w[i:] for i in range(len(w))]
    names = [(a, b) for a in ["skoathke", *double("skoathke")] for b in ["noatoru", *double("noatoru")]] + [("skoathkx", "noatoru"), ("skoathke", "noatozu"), ("skoathkey", "noatoru")]
    rows = [(i, f"{a} {b} GED 2820 drill 24V 2 Ah", None, None) for i, (a, b) in enumerate(names)] + [(900, "wairkttro cilkith GED 2820 drill 24V 2 Ah", None, None)]
    groups = products.groups(spark.createDataFrame([(*r, "c", "n") for r in rows], ITEM)).collect()
    assert {r.product_id for r in groups if r.item_id != 900} == {0} and [r.product_id for r in groups if r.item_id == 900] == [900]


def test_products_said_to_be_for_someone_and_products_without_a_code(spark):
    rows = [
        (1, "Grimho Fad LEC3560 laptop for students 8GB RAM, black", "Grimho", None), (2, "Grimho Fad lec 3560 notebook, black, fits every bag", "Grimho", ["8192MB RAM"]), (3, "Laptop for school Grimho Fad LEC-3560 RAM 8GB black", "Grimho", []), (4, "Best offer for Grimho Fad LEC3560 black", None, ["8GB RAM"]),
        (5, "Carry case for Grimho Fad LEC3560 8GB RAM black", "Grimho", None), (6, "Grimho LEC3560 sleeve for 8GB RAM black laptop", "Grimho", None), (7, "Gizmo 65w for XPS 13", None, None), (8, "Gizmo 65w for XPS 13", None, None),
        (11, "Noato Breeso drill 24V 2 Ah", "Noato", None), (12, "Cordless drill, Breesoo, 24-Volt", "NOATO Ltd", ["2000mAh"]), (13, "Noato Breeso Maxi drill 24V 2 Ah", "Noato", None), (14, "Noato Breeso headset 24V 2 Ah", "Noato", None), (15, "Noato drill 24V 2 Ah", None, None), (16, "Noato drill 24V 2 Ah", None, None),
        (21, "Vimi Tuckdo drill 18V", "Vimi", ["Model: KQR 5770"]), (22, "Vimi Tuckdo KQR-5770 drill 18V", "Vimi", None),
    ]
    assert grouped(spark, rows) == [*itertools.combinations((1, 2, 3, 4), 2), (11, 12), (21, 22)]


# ---- residue ---------------------------------------------------------------------------------------------------

def test_residue(spark):
    pages = [
        (1, "Please enable JavaScript to view this page."), (2, "Error 403 - forbidden"), (3, "From the gutter you can see {{ city }} while the porch stays warm."), (4, 'The old sign read "the [north] gate" for 9 years.'),
        (5, "A 503 error lasted 486 minutes on the ferry site, said Plooro, but bookings were safe."), (6, "lorem ipsum dolor sit amet consectetur elit"), (7, None), (8, "  "), (9, prose(50_000)), (10, "null, null null"), (10, "null, null null"),
        (11, "Printers once set lorem ipsum for 674 proofs a day; Hoarsk still keeps the old sheets."), (12, "Try again later.\nHTTP 502"), (13, "Home | News | Contact"),
    ] + [(20 + i, f"{n} keeps $home$ as the name of the folder") for i, n in enumerate("Ann Bob Cid Dan Eve Flo".split())]
    df = spark.createDataFrame([(*p, None) for p in pages], "rec_id bigint, text string, host string")
    got = {r.rec_id for r in residue.residue({"t": df}).collect()}
    assert got == {1, 2, 3, 6, 10, 12}
    assert residue.residue({"t": df.limit(0)}).count() == 0
    titles = [("Your title here", True), ("null - h.example", True), ("Homes in {{ price }}", True), ("How Luell cut its 404 Not Found rate by half", False), ("Error-free baking with Ann", False), ("Error", True), (None, False), ("", False)]
    for title, bad in titles:
        assert bool(list(residue.judge_title(title, "h.example"))) is bad, title


def test_residue_of_one_template_is_found_at_every_size(spark):
    names = "Ann Bob Cid Dan Eve Flo Gus Hal Ida Jan".split()
    for n in (4, 6, 10_000):
        df = spark.createDataFrame([(i, f"Dear {{{{ first_name }}}}, {names[i % 10]} {i} has sent you a message from Dale.", f"h{i % 7}") for i in range(n)], "rec_id bigint, text string, host string")
        assert {r.rec_id for r in residue.residue({"t": df}).collect()} == set(range(n))


def test_residue_aligns_records_of_one_template(spark):
    """What reads like a remark on a mark is residue if other records fill or leave out the slot; else it is not."""
    lines = ["The clerk writes {{ name }} on the form 3.", "The clerk writes Ann on the form 12.", "The tutor writes {{ name }} where the greeting goes."]
    df = spark.createDataFrame([(i, x, "h") for i, x in enumerate(lines)], "rec_id bigint, text string, host string")
    assert {r.rec_id for r in residue.residue({"t": df}).collect()} == {0}


def test_residue_aligns_defaults_and_blanks(spark):
    """A slot of a template that holds a default or a blank was never filled, if aligned records fill it in two ways."""
    lines = [
        "Welcome home. Dear Ann, your order 12 has shipped to Dale.", "Dear Bob, your order 7 has shipped to Huwick.", "Dear null, your order undefined has shipped to Dale.", "Dear , your order 9 has shipped to Dale.", "Dear Cid, your order 8 has shipped to . More soon.",
        "A null result was found by Ann.", "The good result was found by Bob.", "The function prints null for the order of Dale.", "We met the agent None in the town.", "We met the agent Flo in the town.", "None of the rooms was warm.", "The clerk met [object Object] on the stair.", "The log prints [object Object] when it ends.",
    ]
    df = spark.createDataFrame([(i, x, "h") for i, x in enumerate(lines)], "rec_id bigint, text string, host string")
    assert {r.rec_id: r.reason for r in residue.residue({"t": df}).collect()} == {2: "default", 3: "default", 4: "default", 11: "slot"}
    titles = spark.createDataFrame([(1, "Homes for sale in null, 3 rooms", "h"), (2, "Homes for sale in Dale, 4 rooms", "h"), (3, "Homes for sale in Huwick, 3 rooms", "h")], df.schema)
    assert {r.rec_id for r in residue.residue({"page_data": titles}).collect()} == {1}


def test_residue_learns_error_templates_from_repetition(spark):
    odd = "Whoopsie 17, the gremlins broke this corner and our crew is sorry"
    pages = [(i, odd.replace("17", str(i)), f"host{i}.example") for i in range(4)] + [(10 + i, "Whoopsie, the lamp broke and Ann is sorry", "one.example") for i in range(4)] + [(20, prose(40), "host1.example")]
    df = spark.createDataFrame(pages, "rec_id bigint, text string, host string")
    assert {r.rec_id for r in residue.residue({"t": df}).collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize(("text", "bad"), [
    ("Oops! That page can't be found.", True), ("Sorry, something went wrong on our side.", True), ("Nous sommes désolés, cette page n'existe plus.", True), ("Error 503 Service Unavailable\nPlease try again later\n" * 4, True), ("[object  Object] ", True),
    ("Buy $INSERT DESCRIPTION HERE$ online", True), ("Home\nContact\nLog in", False), ("We went home because it was late", False), ("Sorry seems to be the hardest word", False), (None, False), ("", False),
])
def test_residue_of_unlisted_messages(text, bad):
    assert bool(residue.judge(text)) is bad


def test_residue_evidence_is_that_of_the_sentence():
    assert residue.judge("The page was printed in May. Dear {{ user.first_name }}, the environment of the house has variable light.") == "slot"
    assert residue.judge("The monitor is 15\" wide. Ask {{ agent_phone }} for more.") == "slot"
    assert residue.judge("In the tutorial the template writes {{ name }} where the greeting goes.") is None
    assert residue.judge("Set ${CACHE_DIR} to a disk with 9 free gigabytes, advises Ann. Call ${agent_phone} today.") == "slot"
    assert residue.judge("The variable $HOME$ names a folder.") is None
    body = "\n".join(f"{prose(12)}." for _ in range(9))
    assert residue.judge(body) is None and residue.judge("Not found\n" + body) is None
    assert residue.judge(f"{body}\nPlease enable JavaScript to view this page.\n{body}") == "message"
    assert residue.judge(f"{body}\nError 503 service unavailable\n{body}") == "message"


# ---- boilerplate -----------------------------------------------------------------------------------------------

def page(k, r):
    """A page of invented furniture and body with its labels (True: body)."""
    sentence = lambda: f"The {r.choice(WORDS)} near {r.choice(WORDS).title()} was measured by a crew from {r.choice(WORDS).title()} after {r.randrange(99)} hours of quiet work."
    out = [(f"We use cookies. Accept all {k}", False)] * r.randrange(2) + [(x, False) for x in ("Home", "Contact", "My account")[: r.randrange(4)]]
    out += [(f"Why the {r.choice(WORDS).title()} gate was moved, by Ann", True)] + [("By Ann Bell", False)] * r.randrange(2)
    for _ in range(r.randrange(1, 5)):
        out += [(" ".join(sentence() for _ in range(r.randrange(1, 4))), True)] + [(x, b) for x, b in [("Save this item to read later", False), ("Sturdy bridge near Dale opened by Bob", True), ("", None)] if r.random() < 0.3]
    if r.random() < 0.5:
        out += [("Readers also viewed", False)] + [(f"Quiet {w} near Dale opened by Bob", False) for w in r.sample(WORDS, r.randrange(2, 5))]
    return out + [(x, False) for x in ("(c) 2024 Site. All rights reserved.", "Back to top")[: r.randrange(1, 3)]]


def test_boilerplate_accuracy_on_held_out_pages(spark):
    r = random.Random(3)
    pages = {k: page(k, r) for k in range(300)}
    df = spark.createDataFrame([(k, "\n".join(x for x, _ in p), None) for k, p in pages.items()], "page_id bigint, main_content string, title string")
    got = {(x.rec_id, x.line_no): x.is_body for x in boilerplate.judged({"page_data": df}, max_pages=60).collect()}
    marks = [(got[k, n], b) for k, p in pages.items() for n, (x, b) in enumerate(p, 1) if x.strip()]
    assert sum(a == b for a, b in marks) / len(marks) > 0.98


def other_page(k, r):
    """A page whose furniture has none of the listed phrases, with short headings and lists in its body."""
    sentence = lambda: f"{r.choice(WORDS).title()} walked to the {r.choice(WORDS)} with {r.randrange(2, 99)} friends, and nobody minded the {r.choice(WORDS)} weather on the way."
    out = [(x, False) for x in ("Start", "Shop", "Team", "Stores", "Jobs")[: r.randrange(2, 6)]] + [(f"A {r.choice(WORDS)} walk past {r.choice(WORDS).title()} town {k}", True)]
    for _ in range(r.randrange(2, 5)):
        out += [(r.choice(["Method", "What to bring", "The way back"]), True)] * (r.random() < 0.4) + [(" ".join(sentence() for _ in range(r.randrange(1, 4))), True)]
        out += [(f"- {r.randrange(2, 9)} {r.choice(WORDS)}", True) for _ in range(r.randrange(2, 4))] * (r.random() < 0.4)
    if r.random() < 0.5:
        out += [("Keep reading", False)] + [(f"{r.randrange(3, 20)} {w} ideas for a {r.choice(WORDS)} weekend", False) for w in r.sample(WORDS, r.randrange(2, 5))]
    return out + [(x, False) for x in ("Imprint | Press | Data", "© Site 2024")]


def test_boilerplate_accuracy_on_phrases_of_no_list(spark):
    r = random.Random(8)
    pages = {k: other_page(k, r) for k in range(300)}
    df = spark.createDataFrame([(k, "\n".join(x for x, _ in p), None) for k, p in pages.items()], "page_id bigint, main_content string, title string")
    got = {(x.rec_id, x.line_no): x.is_body for x in boilerplate.judged({"page_data": df}, max_pages=60).collect()}
    marks = [(got[k, n], b) for k, p in pages.items() for n, (x, b) in enumerate(p, 1)]
    right = sum(a == b for a, b in marks) / len(marks)
    assert right > 0.95, right


def test_boilerplate_keeps_a_recipe(spark):
    lines = ["Home", "Recipes", "Contact us", "Grandmother's soda bread", "This bread takes an hour and needs no yeast, which makes it a friend of busy evenings.", "Ingredients", "- 450 g flour", "- 1 tsp salt", "Method",
             "Heat the oven to 200 degrees and flour a tray.", "Bake the cookies beside it; our cookies policy is simple.", "Recommended for you", "Ten ways to save water this summer", "Five cheap dinners for a cold evening", "© 2024 The Kitchen"]
    df = spark.createDataFrame([(1, "\n".join(lines), "Grandmother's soda bread")], "page_id bigint, main_content string, title string")
    assert [r.line_no for r in boilerplate.found({"page_data": df}).orderBy("line_no").collect()] == [1, 2, 3, 12, 13, 14, 15]


def test_sum_product_equals_enumeration():
    rng = np.random.default_rng(1)
    z, f = len(boilerplate.ZONES), len(boilerplate.FORMS)
    model = rng.random(z), rng.random((z, z)), rng.random((z, f))
    forms = np.array([[1, 4, 2, 7], [3, 3, -1, -1]])
    zones, _ = boilerplate.marginals(forms, np.array([4, 2]), model)
    for row, n in ((0, 4), (1, 2)):
        weight = np.zeros((n, z))
        for path in itertools.product(range(z), repeat=n):
            w = model[0][path[0]] * np.prod([model[1][a, b] for a, b in itertools.pairwise(path)]) * np.prod([model[2][s, forms[row, k]] for k, s in enumerate(path)])
            for k, s in enumerate(path):
                weight[k, s] += w
        assert np.allclose(zones[row, :n], weight / weight.sum(axis=1, keepdims=True))


def test_boilerplate_edges(spark):
    rows = [(1, None, None, "a"), (2, "", "t", "a"), (3, " \n ", "t", "a"), (4, "Please enable JavaScript to view this page.", "t", "a"), (5, "Home\n" * 3, None, "a"), (5, "Home\n" * 3, None, "a"), (6, prose(100_000) + ".", None, "a"), (None, "Home", None, "a")]
    df = spark.createDataFrame(rows, "page_id bigint, main_content string, title string, src_table string")
    got = sorted((r.rec_id, r.line_no) for r in boilerplate.found({"page_data": df}).collect())
    assert got == [(5, 1), (5, 2), (5, 3)]
    assert boilerplate.found({"page_data": df.limit(0)}).count() == 0


def test_main_bodies_are_the_texts_without_the_found_lines(spark):
    r = random.Random(4)
    pages = {k: "\n".join(x for x, _ in page(k, r)) for k in range(40)} | {90: None, 91: "", 92: "Please enable JavaScript to view this page."}
    df = {"page_data": spark.createDataFrame([(k, t, None) for k, t in [*pages.items(), (0, pages[0])]], "page_id bigint, main_content string, title string")}
    gone = {(x.rec_id, x.line_no) for x in boilerplate.found(df).collect()}
    got = [(x.rec_id, x.main_body) for x in boilerplate.main_bodies(df).collect()]
    want = {k: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (k, n) not in gone) for k, t in pages.items()}
    assert len(got) == len(pages) and dict(got) == want and gone
