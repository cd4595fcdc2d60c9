"""Further joins, scores, checks and consolidation rules."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions import urls
from loomwork.functions import values as N
from loomwork.html.columns import escape, read, selected
from loomwork.operators import dedup, validate
from loomwork.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
ONE = r"trim(regexp_replace({0}, '[ \t\n\r\f\v\x{{00A0}}]+', ' ', 'g'))"


@query(r"SELECT content_id, trim(regexp_replace(regexp_replace(content, '(?i)back to top|all rights reserved\.?|read more', '', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS text FROM scraped_content")
def T6_noise_phrases(spark, d):
    c = F.regexp_replace("content", r"(?i)back to top|all rights reserved\.?|read more", "")
    return table(spark, d, "scraped_content", "content_id", "content").select("content_id", T.clean_whitespace(c).alias("text"))


@query(f"SELECT hit_id, round(CASE WHEN len(list_distinct({WORDS.format('query_text')})) > 0 THEN len(list_intersect(list_distinct({WORDS.format('query_text')}), list_distinct({WORDS.format('snippet')}))) / len(list_distinct({WORDS.format('query_text')})) END, 6) AS overlap FROM search_results WHERE snippet IS NOT NULL")
def T23_overlap(spark, d):
    q, s = F.array_distinct(T.words(F.col("query_text"))), F.array_distinct(T.words(F.col("snippet")))
    return table(spark, d, "search_results").filter("snippet is not null").select("hit_id", F.round(F.when(F.size(q) > 0, F.size(F.array_intersect(q, s)) / F.size(q)), 6).alias("overlap"))


@query("SELECT hit_id, CASE WHEN relevance_score IS NULL THEN 0 WHEN relevance_score BETWEEN 0 AND 1 THEN 1 ELSE 0.5 END::DOUBLE AS score FROM search_results")
def N13_plausible(spark, d):
    s = F.col("relevance_score")
    return table(spark, d, "search_results").select("hit_id", F.when(s.isNull(), 0.0).when(s.between(0, 1), 1.0).otherwise(0.5).alias("score"))


@query("SELECT hit_id, length(title) AS n, contains(lower(url), '?') AS has_query, regexp_matches(title, '[0-9]') AS has_number, round(0.5 + 0.2 * contains(lower(url), 'lang=en')::INT - 0.1 * contains(url, '&')::INT, 6)::DOUBLE AS score FROM search_results")
def L7_link_features(spark, d):
    u, t = F.col("url"), F.col("title")
    score = F.lit(0.5) + 0.2 * F.contains(F.lower(u), F.lit("lang=en")).cast("int") - 0.1 * F.contains(u, F.lit("&")).cast("int")
    return table(spark, d, "search_results").select("hit_id", F.length(t).cast("bigint").alias("n"), F.contains(u, F.lit("?")).alias("has_query"), t.rlike("[0-9]").alias("has_number"), F.round(score, 6).alias("score"))


@query("SELECT page_id, coalesce(json_extract_string(structured_data, '$.headings[0]'), title, 'untitled') AS title FROM page_data")
def J8_metadata_priority(spark, d):
    return table(spark, d, "page_data").select("page_id", F.coalesce(F.get_json_object("structured_data", "$.headings[0]"), "title", F.lit("untitled")).alias("title"))


@query("WITH m AS (SELECT max(ts) AS t FROM events) SELECT event_type, count(*) FILTER (WHERE ts > t - INTERVAL 1 DAY) AS recent, count(*) FILTER (WHERE ts <= t - INTERVAL 1 DAY AND ts > t - INTERVAL 2 DAYS) AS previous FROM events, m GROUP BY event_type")
def J11_against_previous(spark, d):
    e = table(spark, d, "events")
    df = e.join(F.broadcast(e.agg(F.max("ts").alias("t"))), F.col("ts") <= F.col("t"))
    day, two = F.col("t") - F.expr("INTERVAL 1 DAY"), F.col("t") - F.expr("INTERVAL 2 DAYS")
    return df.groupBy("event_type").agg(F.count_if(F.col("ts") > day).alias("recent"), F.count_if((F.col("ts") <= day) & (F.col("ts") > two)).alias("previous"))


@query("SELECT 'title' AS field, round(avg((title IS NOT NULL)::INT), 6) AS coverage FROM broker_results UNION ALL SELECT 'price', round(avg((price IS NOT NULL)::INT), 6) FROM broker_results")
def A18_coverage(spark, d):
    one = table(spark, d, "broker_results").agg(*[F.round(F.avg(F.col(c).isNotNull().cast("int")), 6).alias(c) for c in ("title", "price")])
    return one.unpivot([], ["title", "price"], "field", "coverage")


@query("SELECT result_id, round(((trim(coalesce(title, '')) <> '')::INT + (trim(coalesce(price, '')) <> '')::INT + (trim(coalesce(image_url, '')) <> '')::INT + (trim(full_text) <> '')::INT) / 4, 6) AS share FROM broker_results")
def A27_profile(spark, d):
    filled = sum(((~N.is_empty(F.col(c))).cast("int") for c in ("title", "price", "image_url", "full_text")), F.lit(0))
    return table(spark, d, "broker_results").select("result_id", F.round(filled / 4, 6).alias("share"))


@query(r"""WITH a AS (SELECT doc_id, coalesce(nullif(regexp_replace(lower(split_part(split_part(trim(url), '#', 1), '?', 1)), '/+$', ''), ''), '#' || doc_id) AS u, coalesce(nullif(text, ''), chr(1) || doc_id) AS h FROM documents),
  b AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY doc_id) AS r FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS q FROM b WHERE r = 1) SELECT doc_id FROM c WHERE q = 1""")
def U4_whole_keys(spark, d):
    """By the address without query, fragment and trailing slash, then by the whole text; documents have no title. Null and empty keys pass."""
    address = F.regexp_replace(F.lower(F.regexp_replace(F.trim("url"), r"(?s)[?#].*$", "")), "/+$", "")
    df = table(spark, d, "documents", "doc_id", "url", "text").select("doc_id", address.alias("u"), F.when(F.col("text") != "", F.sha2("text", 256)).alias("h"))
    for key in ("u", "h"):
        df = dedup.first_by(df, [F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("#"), F.col("doc_id").cast("string")))], [F.col("doc_id")])
    return df.select("doc_id")


@query("SELECT k, arg_max(result_id, (filled, -result_id)) AS best FROM (SELECT lower(detail_url) AS k, result_id, (title IS NOT NULL)::INT + (price IS NOT NULL)::INT + (image_url IS NOT NULL)::INT AS filled FROM broker_results) GROUP BY k")
def U7_most_complete(spark, d):
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("title", "price", "image_url")), F.lit(0))
    df = table(spark, d, "broker_results").select(F.lower("detail_url").alias("k"), "result_id", filled.alias("filled"))
    return dedup.first_by(df, ["k"], [-F.col("filled"), F.col("result_id")]).select("k", F.col("result_id").alias("best"))


@query("SELECT item_id, url AS _source_url, unnest(features) AS feature FROM (SELECT DISTINCT item_id, url, features FROM listing_items)")
def U14_provenance(spark, d):
    return table(spark, d, "listing_items", "item_id", "url", "features").distinct().filter("size(features) > 0").select("item_id", F.col("url").alias("_source_url"), F.explode("features").alias("feature"))


@query()
def U17_ratio(spark, d):
    """Sequence-matcher ratio of title and snippet, in Arrow batches."""
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=object)

    one = lambda c: F.lower(T.clean_whitespace(F.col(c)))
    return table(spark, d, "search_results").select("hit_id", F.pandas_udf(ratio, "double")(one("query_text"), one("title")).alias("ratio"))


@query("SELECT url, min_by(content, content_id) FILTER (WHERE content <> '') AS content, min_by(error_message, content_id) FILTER (WHERE error_message <> '') AS error_message, count(*) AS n FROM (SELECT DISTINCT content_id, url, nullif(trim(content), '') AS content, nullif(trim(error_message), '') AS error_message FROM scraped_content) GROUP BY url")
def U22_first_filled(spark, d):
    df = table(spark, d, "scraped_content").select("content_id", "url", F.nullif(F.trim("content"), F.lit("")).alias("content"), F.nullif(F.trim("error_message"), F.lit("")).alias("error_message")).distinct()
    return dedup.merge_fill(df, ["url"], F.col("content_id"), ["content", "error_message"]).withColumnRenamed("merge_count", "n")


@query("SELECT p_brand, arg_max(p_partkey, (length(p_name), p_partkey)) AS best, list_sort(list(DISTINCT p_type)) AS types FROM part GROUP BY p_brand")
def U24_best_and_all(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(F.length("p_name").alias("n"), F.col("p_partkey").alias("i"))).alias("best"), F.array_sort(F.collect_set("p_type")).alias("types"))


@query("SELECT hit_id, list_filter([CASE WHEN relevance_score < 0.2 THEN 'relevance_score: below 0.2' END, CASE WHEN NOT regexp_matches(url, '^https://') THEN 'url: pattern' END, CASE WHEN domain IS NULL OR trim(domain) = '' THEN 'domain: required' END], lambda x: x IS NOT NULL) AS errors FROM search_results")
def V3_validators(spark, d):
    r = validate.rule
    return table(spark, d, "search_results").select("hit_id", validate.errors(r("relevance_score", minimum=0.2), r("url", pattern="^https://"), r("domain", required=True)).alias("errors"))


@query("SELECT result_id, coalesce(nullif(trim(title), ''), 'untitled') AS title, left(trim(full_text), 200) AS full_text FROM broker_results")
def V7_defaults(spark, d):
    return table(spark, d, "broker_results").select("result_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("untitled")).alias("title"), F.left(F.trim("full_text"), F.lit(200)).alias("full_text"))


@query(r"SELECT result_id, trim(regexp_replace(title, '[\s\x{00A0}]+', ' ', 'g')) AS title, trim(regexp_replace(title, '[\s\x{00A0}]+', ' ', 'g')) IS DISTINCT FROM title AS corrected FROM broker_results")
def V8_corrections(spark, d):
    fixed = T.clean_whitespace(F.col("title"))
    return table(spark, d, "broker_results").select("result_id", fixed.alias("title"), (~fixed.eqNullSafe(F.col("title"))).alias("corrected"))


@query("SELECT CASE WHEN max(o_totalprice) > 100 * min(o_totalprice) AND max(o_totalprice) - min(o_totalprice) > 1000 THEN 0.8 ELSE 1.0 END::DOUBLE AS price, CASE WHEN count(DISTINCT length(o_orderstatus)) = 1 THEN 1.0 ELSE 0.9 END::DOUBLE AS status FROM orders")
def V9_consistency(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").agg(F.when((F.max(p) > 100 * F.min(p)) & (F.max(p) - F.min(p) > 1000), 0.8).otherwise(1.0).alias("price"), F.when(F.count_distinct(F.length("o_orderstatus")) == 1, 1.0).otherwise(0.9).alias("status"))


@query("SELECT content_id, md5(coalesce(content, '')) IS DISTINCT FROM lag(md5(coalesce(content, ''))) OVER (PARTITION BY url ORDER BY captured_at, content_id) AS changed FROM (SELECT DISTINCT content_id, url, content, captured_at FROM scraped_content)")
def W4_changed(spark, d):
    w = Window.partitionBy("url").orderBy("captured_at", "content_id")
    df = table(spark, d, "scraped_content").select("content_id", "url", "content", "captured_at").distinct().withColumn("h", F.md5(F.coalesce("content", F.lit(""))))
    return df.select("content_id", (~F.col("h").eqNullSafe(F.lag("h").over(w))).alias("changed"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice > 0 AND l_quantity > 0 THEN 1 - least(1, abs(log10(l_extendedprice / l_quantity) - 3) / 3) ELSE 0 END, 6)::DOUBLE AS score FROM lineitem")
def Q9_magnitudes(spark, d):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    score = F.when((p > 0) & (q > 0), 1 - F.least(F.lit(1.0), F.abs(F.log10(p / q) - 3) / 3)).otherwise(0.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("SELECT result_id, round(0.8 * ((title IS NOT NULL)::INT + (full_text IS NOT NULL)::INT) / 2 + 0.2 * ((price IS NOT NULL)::INT + (image_url IS NOT NULL)::INT) / 2 , 6)::DOUBLE AS score, round(least(0.2, length(full_text) / 1000), 6)::DOUBLE AS richness FROM broker_results")
def Q15_completeness(spark, d):
    has = lambda *cs: sum((F.col(c).isNotNull().cast("int") for c in cs), F.lit(0)) / len(cs)
    return table(spark, d, "broker_results").select("result_id", F.round(0.8 * has("title", "full_text") + 0.2 * has("price", "image_url"), 6).alias("score"), F.round(F.least(F.lit(0.2), F.length("full_text") / 1000), 6).alias("richness"))


@query("SELECT hit_id, CASE WHEN s >= 0.9 THEN 'Excellent' WHEN s >= 0.8 THEN 'Good' WHEN s >= 0.7 THEN 'Satisfactory' WHEN s >= 0.6 THEN 'Fair' ELSE 'Poor' END AS rating FROM (SELECT hit_id, CASE WHEN relevance_score IS NULL THEN is_valid::INT ELSE (0.25 * is_valid::INT + 0.3 * relevance_score) / 0.55 END AS s FROM search_results)")
def Q16_rating(spark, d):
    v = F.col("is_valid").cast("int")
    s = F.when(F.col("relevance_score").isNull(), v).otherwise((0.25 * v + 0.3 * F.col("relevance_score")) / 0.55)
    return table(spark, d, "search_results").select("hit_id", F.when(s >= 0.9, "Excellent").when(s >= 0.8, "Good").when(s >= 0.7, "Satisfactory").when(s >= 0.6, "Fair").otherwise("Poor").alias("rating"))


@query("SELECT result_id, CASE WHEN length(full_text) >= 200 THEN 'full_text' WHEN title IS NOT NULL THEN 'title' ELSE 'none' END AS used, CASE WHEN length(full_text) >= 200 THEN full_text ELSE coalesce(title, '') END AS body FROM broker_results")
def Q23_fallback(spark, d):
    """The first extractor whose quality suffices."""
    good = F.length("full_text") >= 200
    return table(spark, d, "broker_results").select("result_id", F.when(good, "full_text").when(F.col("title").isNotNull(), "title").otherwise("none").alias("used"), F.when(good, F.col("full_text")).otherwise(F.coalesce("title", F.lit(""))).alias("body"))


@query(r"SELECT page_id, strpos(main_content, regexp_extract(main_content, '[0-9]{3}-[0-9]{4}')) AS at, regexp_extract(main_content, '[0-9]{3}-[0-9]{4}') AS found FROM page_data WHERE regexp_matches(main_content, '[0-9]{3}-[0-9]{4}')")
def H13_pattern_positions(spark, d):
    hit = F.regexp_extract("main_content", "[0-9]{3}-[0-9]{4}", 0)
    return table(spark, d, "page_data").filter(F.col("main_content").rlike("[0-9]{3}-[0-9]{4}")).select("page_id", F.instr("main_content", hit).cast("bigint").alias("at"), hit.alias("found"))


@query("SELECT DISTINCT item_id, " + ONE.format("title") + " AS title, coalesce(" + ONE.format("brand") + ", '') AS brand FROM listing_items")
def H17_schema_extraction(spark, d):
    """Fields by selector, one declared struct out."""
    html = F.concat(F.lit("<div class=item><h2 class=title>"), escape(F.col("title")), F.lit("</h2><span itemprop=brand>"), F.coalesce(escape(F.col("brand")), F.lit("")), F.lit("</span></div>"))
    df = table(spark, d, "listing_items", "item_id", "title", "brand").distinct().withColumn("html", html)
    return df.select("item_id", selected(F.col("html"), ".item > h2.title")[0].alias("title"), F.coalesce(read("metadata", F.col("html"))["item:brand"], F.lit("")).alias("brand")).distinct()


@query("SELECT content_id, CASE WHEN regexp_matches(url, '/product/') THEN 'product' WHEN regexp_matches(url, '/(news|home)/') THEN 'article' ELSE 'other' END AS kind FROM scraped_content")
def H21_page_type(spark, d):
    u = F.col("url")
    return table(spark, d, "scraped_content").select("content_id", F.when(u.rlike("/product/"), "product").when(u.rlike("/(news|home)/"), "article").otherwise("other").alias("kind"))


@query(r"SELECT host, count(*) AS n FROM (SELECT coalesce(nullif(regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\.', ''), ''), 'unknown') AS host FROM scraped_content) GROUP BY host")
def A23_by_host(spark, d):
    return table(spark, d, "scraped_content", "url").groupBy(F.coalesce(urls.host(F.col("url")), F.lit("unknown")).alias("host")).agg(F.count("*").alias("n"))
