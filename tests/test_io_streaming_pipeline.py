import pytest
from pyspark.sql import functions as F

from loomwork import sinks, streaming
from loomwork.html import tree
from loomwork.plans import pipeline
from loomwork.sources import files


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "a,\"b\"", {"x": 1}, [1, 2]), (2, None, {"x": None}, None), (3, "ü\nz", None, [])], "id bigint, name string, s struct<x:int>, l array<int>")


def test_json_csv_xml_text_round_trips(spark, rows, tmp_path):
    sinks.write_json(rows, f"{tmp_path}/j.jsonl")
    assert sorted(files.read(spark, f"{tmp_path}/j.jsonl", schema=rows.schema).collect()) == sorted(rows.collect())
    sinks.write_json(rows, f"{tmp_path}/c.jsonl", sort_keys=True)
    assert files.read(spark, f"{tmp_path}/c.jsonl", "text").filter("value like '{\"id\":1,%'").count() == 1
    sinks.write_csv(rows, f"{tmp_path}/c.csv")
    back = {r.id: r for r in files.read(spark, f"{tmp_path}/c.csv").collect()}
    assert back["1"].name == 'a,"b"' and back["3"].name == "ü\nz" and back["1"].l == "[1,2]" and back["1"].s_x == "1"
    sinks.write_xml(rows.select("id", "name"), f"{tmp_path}/x.xml")
    assert {r.id for r in files.read(spark, f"{tmp_path}/x.xml").collect()} == {1, 2, 3}
    sinks.write_text(rows, f"{tmp_path}/t.txt", "%s:%s", ["id", "name"])
    assert {"2:"} <= {r.value for r in files.read(spark, f"{tmp_path}/t.txt", "text").collect()}
    sinks.write_markdown(rows, f"{tmp_path}/m.md")
    sinks.write_table(rows, f"{tmp_path}/p", ["id"], 2)
    assert spark.read.parquet(f"{tmp_path}/p").count() == 3
    sinks.write_table(rows.select("id", "name"), f"{tmp_path}/old")
    sinks.write_upsert(spark.createDataFrame([(1, "new"), (9, "nine")], "id bigint, name string"), f"{tmp_path}/old", "id", f"{tmp_path}/new")
    assert {r.id: r.name for r in spark.read.parquet(f"{tmp_path}/new").collect()} == {1: "new", 2: None, 3: "ü\nz", 9: "nine"}


def test_listing_and_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.csv.gz").write_bytes(b"x")
    (tmp_path / "c").write_bytes(b"xyz")
    got = {r.name: (r.size, r.format) for r in files.listing(spark, str(tmp_path)).collect()}
    assert got == {"a.json": (2, "json"), "b.csv.gz": (1, "csv"), "c": (3, "binary")}
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://h.example/a</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://h.example/b</loc></url></urlset>")
    assert {r.loc for r in files.sitemap(spark, f"{tmp_path}/s.xml").collect()} == {"https://h.example/a", "https://h.example/b"}


def run_stream(spark, stream, tmp_path, mode="append"):
    name = "out_" + tmp_path.name.replace("-", "_")
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_streams_equal_batches(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").filter("event_id <= 300").orderBy("ts")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    aggs = [F.count("*").alias("n"), F.max("value").alias("high")]
    both = lambda f: (run_stream(spark, f(stream), tmp_path / f.__name__, "complete"), sorted(map(tuple, f(batch).collect())))

    def tumbling(df):
        return streaming.tumbling(df, "ts", "5 minutes", ["event_type"], aggs)

    def sliding(df):
        return streaming.sliding(df, "ts", "5 minutes", "1 minute", [], aggs)

    for f in (tumbling, sliding):
        (tmp_path / f.__name__).mkdir()
        a, b = both(f)
        assert a == b and a
    (tmp_path / "bucket").mkdir()
    got = run_stream(spark, streaming.token_bucket(stream, "user_id", "event_id", "ts", 1e-9, 1), tmp_path / "bucket")
    want = sorted(map(tuple, streaming.token_bucket(batch, "user_id", "event_id", "ts", 1e-9, 1).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want] and {x[2] for x in want} == {True, False}
    half = streaming.running_totals(batch.filter("event_id % 2 = 0"), None, ["event_type"], "value")
    whole = streaming.running_totals(batch.filter("event_id % 2 = 1"), half, ["event_type"], "value")
    assert {r.event_type: r.n for r in whole.collect()} == {r.event_type: r["count"] for r in batch.groupBy("event_type").count().collect()}


def test_pipeline(spark, rows):
    config = {"stages": [
        {"type": "filter", "config": {"conditions": [{"field": "id", "operator": "greater_equal", "value": "${least}"}]}},
        {"type": "transform", "config": {"casts": {"name": "uppercase"}, "include": ["id", "name"]}},
        {"type": "branch", "config": {"conditions": [{"field": "name", "operator": "exists"}], "then": [{"type": "transform", "config": {"rename": {"name": "label"}}}]}},
        {"type": "sort_limit", "config": {"by": ["-id"], "limit": 5}, "enabled": True},
    ]}
    got = [tuple(r) for r in pipeline.from_config(config, {"least": 2}).run(rows).select("id", "label", "name").collect()]
    assert got == [(3, "Ü\nZ", None), (2, None, None)]
    with pytest.raises(ValueError):
        pipeline.from_config({"stages": [{"type": "nothing"}]})
    checked = pipeline.Pipeline().add("validate", rules={"name": {"required": True}}, keep_invalid=False).run(rows)
    assert {r.id for r in checked.collect()} == {1, 3}


def test_tree_on_broken_markup():
    assert tree.parse("").text() == "" and tree.tables(None) == []
    assert tree.lists("<ul><li>a<li>b<ul><li>c</ul></ul>")[0]["items"] == ["a", "b\nc".replace("\n", " ")]
    assert tree.parse("</p><b>x<i>y</b>z").text() == "xyz"
    assert [n.text() for n in tree.select(tree.parse("<div id=a><p class='x y'>1</p><span><p>2</p></span></div>"), "#a > p.x, span p")] == ["1", "2"]
    assert tree.tables("<table><tr><td colspan=2>a<td>b</table>")[0]["rows"] == [["a", "a", "b"]]
    assert tree.links("<a href='http://[x'>z</a><a href=/q>w</a>", "https://h.example/p") == [{"url": "https://h.example/q", "text": "w", "rel": "", "internal": True}]
