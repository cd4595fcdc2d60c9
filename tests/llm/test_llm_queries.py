import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare  # noqa: E402

from loomwork.llm.queries import ORACLES, QUERIES  # noqa: E402


def rows(spark, data, name):
    return sorted(map(tuple, QUERIES[name](spark, data).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, name):
    # The choice of tokenizer matters below scale 0.01.
    folder = data.replace("sf0.001", "sf0.01") if name == "p9_found" else data
    compare(QUERIES[name](spark, folder), ORACLES[name], folder)


def test_p3_pages_leave_out_what_p3_found_lists(spark, data):
    found = QUERIES["p3_found"](spark, data).groupBy("src_table", "rec_id").count().collect()
    gone = {(r.src_table, r.rec_id): r["count"] for r in found}
    pages = {(r.src_table, r.rec_id): r for r in QUERIES["p3_pages"](spark, data).collect()}
    assert gone and all(pages[k].n_lines - pages[k].n_body >= n for k, n in gone.items())
    assert all(r.n_lines == r.n_body for k, r in pages.items() if k not in gone)


def test_p4_pairs_are_the_groups(spark, data):
    groups = {}
    for r in QUERIES["p4_groups"](spark, data).collect():
        groups.setdefault(r.product_id, []).append(r.item_id)
    want = sorted((a, b) for g in groups.values() for a in g for b in g if a < b)
    assert want and sorted(map(tuple, QUERIES["p4_found"](spark, data).collect())) == want
    assert all(k == min(g) for k, g in groups.items())


def test_p5_reasons_are_of_the_found_records(spark, data):
    reasons = QUERIES["p5_reasons"](spark, data).collect()
    assert reasons and {(r.src_table, r.rec_id) for r in reasons} == set(map(tuple, QUERIES["p5_found"](spark, data).collect()))
    assert {r.src_table for r in reasons} == {"scraped_content", "broker_results", "page_data"}


def test_p6_records_are_the_collapsed_ones(spark, data):
    records = QUERIES["p6_records"](spark, data).select("src_table", "rec_id", "n_copies").collect()
    assert records and sorted(map(tuple, records)) == [tuple(x) for x in rows(spark, data, "p6_collapsed")] or {tuple(r) for r in records} == set(rows(spark, data, "p6_collapsed"))


def test_p8_verbatim_leaks_are_found(spark, data):
    leaks = QUERIES["p8_leaks"](spark, data).collect()
    assert {(r.item_id, r.doc_id) for r in leaks if r.kind == "verbatim"} == set(rows(spark, data, "p8_found"))


def test_p9_shares_are_those_of_the_selected(spark, data):
    taken = {}
    for r in QUERIES["p9_selected"](spark, data).collect():
        taken[r.source] = taken.get(r.source, 0) + r.n_tokens * r.copies
    shares = {r.source: r for r in QUERIES["p9_shares"](spark, data).collect()}
    assert taken and {s: r.mix_tokens for s, r in shares.items() if r.mix_tokens} == taken
