"""The remaining functions, projections, aggregates, windows and consolidation rules."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import chunks, urls
from loomwork.functions import text as T
from loomwork.functions import values as N
from loomwork.operators import dedup, metrics, project
from loomwork.plans.pipeline import Pipeline, from_config
from loomwork.sources import table
from loomwork.sources.files import lookup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


HOST = r"regexp_replace(regexp_extract(lower({0}), '^[a-z]+://([^/?#:]*)', 1), '^www\.', '')"


@query("SELECT doc_id, length(text) AS n, 0 AS lost FROM documents WHERE text IS NOT NULL AND text <> ''")
def T14_char_chunks(spark, d):
    """Chunks without overlap put together again are the text."""
    df = table(spark, d, "documents", "doc_id", "text").filter("text is not null and text <> ''")
    c = df.select("doc_id", "text", chunks.column(chunks.by_chars, chunks.CHUNK, F.col("text"), 500, 0).alias("c"))
    whole = F.array_join(F.transform("c", lambda x: x["chunk"]), "")
    return c.select("doc_id", F.length(whole).cast("bigint").alias("n"), F.when(whole == F.col("text"), 0).otherwise(1).alias("lost"))


@query("SELECT doc_id, length(text) AS n, true AS fits FROM documents WHERE text IS NOT NULL AND text <> ''")
def T13_sentence_chunks(spark, d):
    df = table(spark, d, "documents", "doc_id", "text").filter("text is not null and text <> ''")
    c = df.select("doc_id", chunks.column(chunks.by_sentences, chunks.CHUNK, F.col("text"), 120).alias("c"))
    fits = F.forall("c", lambda x: (F.length(x["chunk"]) <= 4 * 120) | ~x["chunk"].rlike(r"[.!?]\s+\S"))
    return c.select("doc_id", F.length(F.array_join(F.transform("c", lambda x: x["chunk"]), "")).cast("bigint").alias("n"), fits.alias("fits"))


@query()
def T16_summary(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", chunks.column(chunks.summary, "string", F.col("text")).alias("summary"))


@query()
def T5_normalised(spark, d):
    return table(spark, d, "scraped_content", "content_id", "content").select("content_id", chunks.column(chunks.normalised, "string", F.col("content")).alias("text"))


@query("SELECT hit_id, trim(regexp_replace(regexp_replace(coalesce(snippet, '') || ' see https://h.example/x', 'https?://[^ ]+', '', 'g'), '[ ]+', ' ', 'g')) AS text FROM search_results")
def T7_without_addresses(spark, d):
    c = F.concat(F.coalesce("snippet", F.lit("")), F.lit(" see https://h.example/x"))
    return table(spark, d, "search_results").select("hit_id", F.trim(F.regexp_replace(F.regexp_replace(c, "https?://[^ ]+", ""), "[ ]+", " ")).alias("text"))


@query(r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+ [A-Z][a-z]+\b'))) AS names, len(regexp_extract_all(text, '\b\d+\b')) AS numbers FROM documents WHERE text IS NOT NULL")
def T21_entities(spark, d):
    t = F.col("text")
    names = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"))))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", names.cast("bigint").alias("names"), F.size(F.regexp_extract_all(t, F.lit(r"\b(\d+)\b"))).cast("bigint").alias("numbers"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 0.5 ELSE 1.0 END::DOUBLE AS validity FROM orders")
def N2_date_parts(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(t).cast("bigint").alias("y"), F.month(t).cast("bigint").alias("m"), F.date_format(t, "yyyy-MM-dd").alias("iso"), F.when(t > F.lit("1998-01-01").cast("timestamp_ntz"), 0.5).otherwise(1.0).alias("validity"))


@query("SELECT p_partkey, (DATE '2024-06-30' - (p_size * 7)::INT) AS day FROM part")
def N3_relative_date(spark, d):
    return table(spark, d, "part").select("p_partkey", N.relative_date(F.concat(F.lit("about "), F.col("p_size"), F.lit(" weeks ago")), F.lit("2024-06-30").cast("date")).alias("day"))


@query("SELECT c_custkey, round(c_acctbal * CASE c_custkey % 3 WHEN 0 THEN 1.0812 WHEN 1 THEN 1.2647 ELSE 1 END, 2)::DOUBLE AS usd FROM customer")
def N6_currency(spark, d):
    from loomwork.operators import units

    rates = [("EUR", "USD", 1.0812, 0.0), ("GBP", "USD", 1.2647, 0.0)]
    df = table(spark, d, "customer").withColumn("code", F.expr("CASE c_custkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'USD' END"))
    return units.convert(df, "c_acctbal", "code", rates, "USD", "usd").select("c_custkey", F.round("usd", 2).alias("usd"))


@query(r"SELECT content_id, regexp_extract(content, 'phone (\d{3})-(\d{4})', 1) AS area, regexp_extract(content, 'phone (\d{3})-(\d{4})', 2) AS line FROM scraped_content WHERE content IS NOT NULL")
def N11_phone_parts(spark, d):
    c = F.col("content")
    return table(spark, d, "scraped_content").filter("content is not null").select("content_id", F.regexp_extract(c, r"phone (\d{3})-(\d{4})", 1).alias("area"), F.regexp_extract(c, r"phone (\d{3})-(\d{4})", 2).alias("line"))


@query("SELECT hit_id, CASE WHEN starts_with(lower(u), 'http') THEN u ELSE 'https://' || u END AS url FROM (SELECT hit_id, CASE WHEN hit_id % 2 = 0 THEN url ELSE split_part(url, '://', 2) END AS u FROM search_results)")
def L4_with_scheme(spark, d):
    u = F.expr("CASE WHEN hit_id % 2 = 0 THEN url ELSE split_part(url, '://', 2) END")
    return table(spark, d, "search_results").select("hit_id", F.when(F.lower(u).startswith("http"), u).otherwise(F.concat(F.lit("https://"), u)).alias("url"))


@query("SELECT hit_id, regexp_replace(url, 'page=[0-9]+', 'page=' || (regexp_extract(url, 'page=([0-9]+)', 1)::INT + 1)) AS next FROM search_results WHERE regexp_matches(url, 'page=[0-9]{1,6}(&|$)')")
def L8_next_page(spark, d):
    u = F.col("url")
    n = F.regexp_extract(u, "page=([0-9]+)", 1).try_cast("int") + 1
    return table(spark, d, "search_results").filter(u.rlike("page=[0-9]{1,6}(&|$)")).select("hit_id", F.regexp_replace(u, F.lit("page=[0-9]+"), F.concat(F.lit("page="), n)).alias("next"))


@query("SELECT page_id, json_extract_string(structured_data, '$.word_count')::INT AS words FROM page_data WHERE structured_data IS NOT NULL")
def C5_json_from_script(spark, d):
    """An object assigned in a script, cut out of the text and read."""
    script = F.concat(F.lit("var a=1; window.__DATA__ = "), F.col("structured_data"), F.lit(";\nrun();"))
    found = F.regexp_extract(script, r"window\.__DATA__ = (\{.*\});", 1)
    return table(spark, d, "page_data").filter("structured_data is not null").select("page_id", F.get_json_object(found, "$.word_count").try_cast("int").alias("words"))


@query("SELECT item_id, len(features) >= 1 AS enough, len(features) <= 3 AS not_too_many, len(features) = len(list_distinct(features)) AS all_differ FROM (SELECT DISTINCT item_id, features FROM listing_items) WHERE features IS NOT NULL")
def C7_items(spark, d):
    f = F.col("features")
    return table(spark, d, "listing_items", "item_id", "features").distinct().filter("features is not null").select("item_id", (F.size(f) >= 1).alias("enough"), (F.size(f) <= 3).alias("not_too_many"), (F.size(f) == F.size(F.array_distinct(f))).alias("all_differ"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal * 2 AS doubled, 'x' AS origin FROM supplier")
def P3_add_fields(spark, d):
    return project.transform(table(spark, d, "supplier"), include=["s_suppkey", "s_name", "doubled", "origin"], rename={"s_suppkey": "id", "s_name": "name"}, add={"doubled": F.col("s_acctbal") * 2, "origin": F.lit("x")})


@query("SELECT n_nationkey, n_name AS \"nation.name\", r_name AS \"region.name\" FROM nation JOIN region ON r_regionkey = n_regionkey")
def P8_restructure(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    nested = n.select("n_nationkey", F.struct(F.col("n_name").alias("name")).alias("nation"), F.struct(F.col("r_name").alias("name")).alias("region"))
    return project.flatten(nested, ".")


@query("SELECT result_id, regexp_matches(lower(coalesce(image_url, '')), '\\.(jpg|jpeg|png|gif|webp|mp4|pdf)$') AS media FROM broker_results")
def P16_media(spark, d):
    return table(spark, d, "broker_results").select("result_id", F.lower(F.coalesce("image_url", F.lit(""))).rlike(r"\.(jpg|jpeg|png|gif|webp|mp4|pdf)$").alias("media"))


@query("SELECT count(*) >= 100 AS enough_items, avg(relevance_score) >= 0.4 AS good_enough, count(relevance_score) / count(*) >= 0.5 AS complete_enough FROM search_results")
def P17_stop_conditions(spark, d):
    s = "relevance_score"
    return table(spark, d, "search_results").agg((F.count("*") >= 100).alias("enough_items"), (F.avg(s) >= 0.4).alias("good_enough"), (F.count(s) / F.count("*") >= 0.5).alias("complete_enough"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 30 DAYS FROM events) GROUP BY user_id")
def A4_recent(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))  # one row
    return e.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 30 DAYS")).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, event_type, count(*) AS attempts, round(sum(value), 4) AS total, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id, event_type")
def A6_running(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("attempts"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(rf"SELECT {HOST.format('url')} AS host, sum(length(content)) AS chars, count(*) AS n FROM scraped_content GROUP BY 1 ORDER BY chars DESC NULLS LAST, host LIMIT 10")
def A8_top_hosts(spark, d):
    g = table(spark, d, "scraped_content", "url", "content").groupBy(urls.host(F.col("url")).alias("host")).agg(F.sum(F.length("content")).alias("chars"), F.count("*").alias("n"))
    return g.orderBy(F.desc_nulls_last("chars"), "host").limit(10)


@query("SELECT round(rating.value) AS stars, count(*) AS n FROM (SELECT DISTINCT item_id, rating FROM listing_items) WHERE rating IS NOT NULL GROUP BY 1")
def A11_histogram(spark, d):
    return table(spark, d, "listing_items", "item_id", "rating").distinct().filter("rating is not null").groupBy(F.round("rating.value").alias("stars")).agg(F.count("*").alias("n"))


@query("SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN price IS NULL THEN 'no price' END, CASE WHEN title IS NULL THEN 'no title' END, CASE WHEN image_url IS NULL THEN 'no image' END], lambda x: x IS NOT NULL)) AS issue FROM broker_results) GROUP BY issue ORDER BY n DESC, issue LIMIT 5")
def A15_top_issues(spark, d):
    issues = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(t)) for c, t in (("price", "no price"), ("title", "no title"), ("image_url", "no image"))]))
    return table(spark, d, "broker_results").select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(5)


@query("SELECT count(*) FILTER (WHERE f >= 0.8) AS high, count(*) FILTER (WHERE f < 0.5) AS low, round(avg(f), 6) AS mean FROM (SELECT ((title IS NOT NULL)::INT + (price IS NOT NULL)::INT + (image_url IS NOT NULL)::INT) / 3 AS f FROM broker_results)")
def A17_completeness(spark, d):
    f = sum((F.col(c).isNotNull().cast("int") for c in ("title", "price", "image_url")), F.lit(0)) / 3
    df = table(spark, d, "broker_results", "title", "price", "image_url").select(f.alias("f"))
    return df.agg(F.count_if(F.col("f") >= 0.8).alias("high"), F.count_if(F.col("f") < 0.5).alias("low"), F.round(F.avg("f"), 6).alias("mean"))


@query("SELECT category, count(*) AS n, min(item_id) AS first FROM (SELECT DISTINCT item_id, category FROM listing_items) WHERE category IS NOT NULL GROUP BY category ORDER BY n DESC, category")
def A21_by_value(spark, d):
    return table(spark, d, "listing_items", "item_id", "category").distinct().filter("category is not null").groupBy("category").agg(F.count("*").alias("n"), F.min("item_id").alias("first")).orderBy(F.desc("n"), "category")


@query("SELECT event_type, user_id % 10 AS grp, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ROLLUP (event_type, user_id % 10)")
def A24_rollup(spark, d):
    return table(spark, d, "events").rollup("event_type", (F.col("user_id") % 10).alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT l_returnflag, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag")
def A26_configured(spark, d):
    config = {"stages": [{"type": "filter", "config": {"conditions": [{"field": "l_discount", "operator": "greater_than", "value": 0.05}]}}, {"type": "aggregate", "config": {"group_by": ["l_returnflag"], "rules": {"quantity": "sum(l_quantity)", "n": "count(*)"}}}]}
    return from_config(config).run(table(spark, d, "lineitem"))


@query("SELECT event_type, max(CASE WHEN value < 10 THEN 2 WHEN value < 50 THEN 1 ELSE 0 END) AS worst FROM events GROUP BY event_type")
def A30_worst(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.max(F.when(v < 10, 2).when(v < 50, 1).otherwise(0)).alias("worst"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
  SELECT user_id, round(avg(value) FILTER (WHERE k <= 20), 6) AS recent, round(avg(value) FILTER (WHERE k > 20), 6) AS before FROM r WHERE k <= 40 GROUP BY user_id""")
def W3_trend(spark, d):
    r = dedup.per_key_rank(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 40)
    return r.groupBy("user_id").agg(F.round(F.avg(F.when(F.col("rank") <= 20, F.col("value"))), 6).alias("recent"), F.round(F.avg(F.when(F.col("rank") > 20, F.col("value"))), 6).alias("before"))


@query("SELECT domain, arg_max(hit_id, (length(snippet), hit_id)) AS hit_id FROM search_results WHERE domain IS NOT NULL AND snippet IS NOT NULL GROUP BY domain")
def W6_best_by(spark, d):
    df = table(spark, d, "search_results", "domain", "hit_id", "snippet").filter("domain is not null and snippet is not null")
    return df.groupBy("domain").agg(F.max_by("hit_id", F.struct(F.length("snippet").alias("n"), F.col("hit_id").alias("i"))).alias("hit_id"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW) / 600, 6) AS rate FROM events")
def W8_rate(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-600_000_000, 0)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w) / 600, 6).alias("rate"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL '60 seconds', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def W10_fixed_window(spark, d):
    w = Window.partitionBy("user_id", F.window("ts", "60 seconds")).orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (F.row_number().over(w) <= 2).alias("allowed"))


@query("SELECT l_orderkey, l_linenumber, sqrt(list_var_pop([l_quantity, l_discount * 100, l_tax * 100, 25.0])) > 0 AND list_max(list_transform([l_quantity, l_discount * 100, l_tax * 100, 25.0], lambda x: abs(x - list_avg([l_quantity, l_discount * 100, l_tax * 100, 25.0])))) > 1.5 * sqrt(list_var_pop([l_quantity, l_discount * 100, l_tax * 100, 25.0])) AS outlier FROM lineitem")
def W11_row_outliers(spark, d):
    xs = F.array(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.lit(25.0))
    mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / 4
    sd = F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / 4)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ((sd > 0) & (F.array_max(F.transform(xs, lambda x: F.abs(x - mean))) > 1.5 * sd)).alias("outlier"))


@query("SELECT hit_id, round(0.8 * ((title IS NOT NULL)::INT + (snippet IS NOT NULL)::INT + (domain IS NOT NULL)::INT + (relevance_score IS NOT NULL)::INT) / 4 + 0.2 * least(coalesce(relevance_score, 0), 1), 6)::DOUBLE AS completeness FROM search_results")
def U8_completeness(spark, d):
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("title", "snippet", "domain", "relevance_score")), F.lit(0))
    return table(spark, d, "search_results").select("hit_id", F.round(0.8 * filled / 4 + 0.2 * F.least(F.coalesce("relevance_score", F.lit(0.0)), F.lit(1.0)), 6).alias("completeness"))


@query(rf"SELECT {HOST.format('url')} || '/' || regexp_extract(url, '^[A-Za-z]+://[^/]+/([^/?#]+)', 1) AS pattern, count(*) AS n, max(length(content)) AS longest FROM scraped_content GROUP BY 1")
def U10_by_pattern(spark, d):
    return table(spark, d, "scraped_content").groupBy(urls.site_pattern(F.col("url")).alias("pattern")).agg(F.count("*").alias("n"), F.max(F.length("content")).cast("bigint").alias("longest"))


@query("SELECT CASE WHEN price IS NOT NULL AND title IS NOT NULL THEN 'detail' WHEN contains(full_text, '|') THEN 'list' ELSE 'unknown' END AS route, count(*) AS n FROM broker_results GROUP BY 1")
def U12_routes(spark, d):
    route = F.when(F.col("price").isNotNull() & F.col("title").isNotNull(), "detail").when(F.contains("full_text", F.lit("|")), "list").otherwise("unknown")
    return table(spark, d, "broker_results").groupBy(route.alias("route")).agg(F.count("*").alias("n"))


@query("SELECT hit_id, round(0.4 * coalesce(relevance_score, 0.5) + 0.3 * (1 / ranking) + 0.2 * CASE WHEN date_diff('day', captured_at::DATE, DATE '2025-06-30') <= 7 THEN 0.9 WHEN date_diff('day', captured_at::DATE, DATE '2025-06-30') <= 30 THEN 0.7 WHEN date_diff('day', captured_at::DATE, DATE '2025-06-30') <= 90 THEN 0.5 ELSE 0.3 END + 0.1 * (snippet IS NOT NULL)::INT, 6)::DOUBLE AS score FROM search_results WHERE captured_at IS NOT NULL")
def U20_ranking(spark, d):
    age = F.datediff(F.lit("2025-06-30").cast("date"), F.col("captured_at").cast("date"))
    fresh = F.when(age <= 7, 0.9).when(age <= 30, 0.7).when(age <= 90, 0.5).otherwise(0.3)
    score = 0.4 * F.coalesce("relevance_score", F.lit(0.5)) + 0.3 * (1 / F.col("ranking")) + 0.2 * fresh + 0.1 * F.col("snippet").isNotNull().cast("int")
    return table(spark, d, "search_results").filter("captured_at is not null").select("hit_id", F.round(score, 6).alias("score"))


@query("SELECT coalesce(nullif(trim(title), ''), nullif(trim(detail_url), '')) AS k, min_by(price, result_id) FILTER (WHERE trim(price) <> '') AS price, min_by(image_url, result_id) FILTER (WHERE trim(image_url) <> '') AS image_url, count(*) AS merge_count FROM broker_results GROUP BY 1")
def U21_entity_merge(spark, d):
    k = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("detail_url"), F.lit("")))
    return dedup.merge_fill(table(spark, d, "broker_results").withColumn("k", k), ["k"], F.col("result_id"), ["price", "image_url"])


@query("SELECT content_id, coalesce(content, error_message, 'nothing') AS body FROM (SELECT DISTINCT content_id, content, error_message FROM scraped_content)")
def U23_prefer(spark, d):
    """The first source that has something wins."""
    return table(spark, d, "scraped_content").select("content_id", "content", "error_message").distinct().select("content_id", F.coalesce("content", "error_message", F.lit("nothing")).alias("body"))


@query("SELECT item_id, list_sort(list_distinct(features)) AS features FROM (SELECT DISTINCT item_id, features FROM listing_items) WHERE features IS NOT NULL")
def U25_distinct_items(spark, d):
    return table(spark, d, "listing_items", "item_id", "features").distinct().filter("features is not null").select("item_id", F.array_sort(F.array_distinct("features")).alias("features"))


@query("SELECT result_id AS id, coalesce(image_url, detail_url) AS link FROM broker_results")
def U26_alias_columns(spark, d):
    return table(spark, d, "broker_results").select(F.col("result_id").alias("id"), F.coalesce("image_url", "detail_url").alias("link"))


@query("SELECT hit_id, relevance_score FROM search_results WHERE relevance_score IS NOT NULL ORDER BY relevance_score DESC, hit_id LIMIT 50")
def O1_top(spark, d):
    return Pipeline().add("sort_limit", by=["-relevance_score", "hit_id"], limit=50).run(table(spark, d, "search_results", "hit_id", "relevance_score").filter("relevance_score is not null"))


@query("SELECT count(*) AS n FROM search_results WHERE domain = 'hearthfinder.example' AND is_valid = true")
def S15_lookup(spark, d):
    return lookup(table(spark, d, "search_results", "domain", "is_valid"), domain="hearthfinder.example", is_valid=True).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS kept FROM search_results WHERE captured_at IS NULL OR captured_at >= TIMESTAMP '2025-06-30 00:00:00' - INTERVAL 30 DAYS")
def K12_retained(spark, d):
    from loomwork.sinks import retained

    return retained(table(spark, d, "search_results", "captured_at"), "captured_at", "2025-06-30 00:00:00", 30).agg(F.count("*").alias("kept"))


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")
def K1_canonical_json(spark, d):
    from loomwork.sinks import canonical_json

    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    return n.select("n_nationkey", canonical_json(n).alias("json"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def R2_hourly(spark, d):
    return metrics.buckets(table(spark, d, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n")]).select("bucket", "event_type", "n")


@query("SELECT doc_id, round(CASE WHEN length(trim(text)) = 0 THEN 0 ELSE 1 END * CASE WHEN length(text) < 20 THEN 0.5 ELSE 1 END * CASE WHEN upper(text) = text THEN 0.7 ELSE 1 END * CASE WHEN length(regexp_replace(text, '[^!?]', '', 'g')) > 0.05 * length(text) THEN 0.8 ELSE 1 END, 6)::DOUBLE AS quality FROM documents WHERE text IS NOT NULL")
def Q7_text_quality(spark, d):
    t = F.col("text")
    q = F.when(F.length(F.trim(t)) == 0, 0.0).otherwise(1.0) * F.when(F.length(t) < 20, 0.5).otherwise(1.0) * F.when(F.upper(t) == t, 0.7).otherwise(1.0) * F.when(F.length(F.regexp_replace(t, "[^!?]", "")) > 0.05 * F.length(t), 0.8).otherwise(1.0)
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.round(q, 6).alias("quality"))


@query("SELECT result_id, round((0.3 * a + 0.25 * b + CASE WHEN c IS NULL THEN 0 ELSE 0.45 * c END) / (0.55 + CASE WHEN c IS NULL THEN 0 ELSE 0.45 END), 6)::DOUBLE AS overall FROM (SELECT result_id, (title IS NOT NULL)::INT AS a, (image_url IS NOT NULL)::INT AS b, CASE WHEN price IS NOT NULL THEN regexp_matches(price, '[0-9]')::INT END AS c FROM broker_results)")
def Q10_overall(spark, d):
    """A weighted mean over the parts that are present, the weights renormalised."""
    parts = [(0.3, F.col("title").isNotNull().cast("int")), (0.25, F.col("image_url").isNotNull().cast("int")), (0.45, F.when(F.col("price").isNotNull(), F.col("price").rlike("[0-9]").cast("int")))]
    top, weight = sum((F.coalesce(w * c, F.lit(0.0)) for w, c in parts), F.lit(0.0)), sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts), F.lit(0.0))
    return table(spark, d, "broker_results").select("result_id", F.round(top / weight, 6).alias("overall"))


@query("SELECT hit_id, CASE WHEN date_diff('day', captured_at::DATE, DATE '2025-06-30') <= 1 THEN 1.0 WHEN date_diff('day', captured_at::DATE, DATE '2025-06-30') <= 7 THEN 0.9 WHEN date_diff('day', captured_at::DATE, DATE '2025-06-30') <= 30 THEN 0.7 WHEN date_diff('day', captured_at::DATE, DATE '2025-06-30') <= 90 THEN 0.5 WHEN captured_at IS NULL THEN 0.5 ELSE 0.3 END::DOUBLE AS freshness FROM search_results")
def Q17_freshness(spark, d):
    age = F.datediff(F.lit("2025-06-30").cast("date"), F.col("captured_at").cast("date"))
    return table(spark, d, "search_results").select("hit_id", F.when(age.isNull(), 0.5).when(age <= 1, 1.0).when(age <= 7, 0.9).when(age <= 30, 0.7).when(age <= 90, 0.5).otherwise(0.3).alias("freshness"))
