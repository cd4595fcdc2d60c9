"""Projections, predicates, validation, joins, aggregates, windows, top-k and consolidation over the test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions import urls
from loomwork.operators import dedup, metrics, predicates, project, validate
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


HOST = r"regexp_replace(regexp_extract(lower({0}), '^[a-z]+://([^/?#:]*)', 1), '^www\.', '')"


@query("SELECT c_custkey AS key, upper(c_name) AS name, lower(c_mktsegment) AS segment, trunc(c_acctbal)::BIGINT AS balance, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS shown FROM customer")
def P4_casts(spark, d):
    df = table(spark, d, "customer").withColumn("shown", F.col("c_mktsegment"))
    return project.transform(df, exclude=["c_nationkey"], rename={"c_custkey": "key", "c_name": "name", "c_mktsegment": "segment", "c_acctbal": "balance"}, casts={"c_name": "uppercase", "c_mktsegment": "lowercase", "c_acctbal": "to_int", "shown": "capitalize"})


@query("SELECT hit_id, CASE WHEN lower(title) IS DISTINCT FROM title THEN ['title'] ELSE [] END AS changed FROM search_results")
def P7_changes(spark, d):
    df = project.transform(table(spark, d, "search_results"), casts={"title": "lowercase", "snippet": "to_string"}, keep_original=True)
    return df.select("hit_id", project.changes(["title", "snippet"]).alias("changed"))


@query("SELECT count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE c) AS c FROM (SELECT coalesce(relevance_score > 0.5, false) AND domain IS NOT NULL AS a, NOT coalesce(contains(snippet, 'the'), false) OR ranking <= 3 AS b, NOT regexp_matches(title, '^(?:Why|What)') AS c FROM search_results)")
def P9_conditions(spark, d):
    c = predicates.condition
    a = predicates.combine([c("relevance_score", "greater_than", 0.5), c("domain", "exists")])
    b = predicates.combine([c("snippet", "not_contains", "the"), c("ranking", "less_equal", 3)], "or")
    e = c("title", "matches", "Why|What", negate=True)
    return table(spark, d, "search_results").agg(F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(e).alias("c"))


@query("SELECT hit_id, relevance_score FROM search_results WHERE is_valid AND relevance_score >= 0.9")
def P12_quality_filter(spark, d):
    return table(spark, d, "search_results", "hit_id", "is_valid", "relevance_score").filter("is_valid and relevance_score >= 0.9").select("hit_id", "relevance_score")


@query(rf"SELECT count(*) AS n FROM search_results WHERE regexp_matches(url, '/(why|what)-[^/]*') AND NOT regexp_matches(url, 'page=[0-9]') AND {HOST.format('url')} LIKE '%.example'")
def P15_url_filters(spark, d):
    u = F.col("url")
    return table(spark, d, "search_results", "url").filter(u.rlike("/(why|what)-[^/]*") & ~u.rlike("page=[0-9]") & urls.host(u).endswith(".example")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > 200000 THEN 'o_totalprice: above 200000' END, CASE WHEN NOT o_orderstatus IN ('O', 'F') THEN 'o_orderstatus: not allowed' END, CASE WHEN length(o_orderpriority) < 6 THEN 'o_orderpriority: shorter than 6' END,
  CASE WHEN o_custkey % 2 <> 0 THEN 'o_custkey: no multiple of 2' END], lambda x: x IS NOT NULL) AS errors FROM orders""")
def V1_rules(spark, d):
    r = validate.rule
    return table(spark, d, "orders").select("o_orderkey", validate.errors(r("o_totalprice", maximum=200000), r("o_orderstatus", enum=["O", "F"]), r("o_orderpriority", min_length=6), r("o_custkey", multiple_of=2)).alias("errors"))


@query("SELECT try_cast(trim(price) AS BIGINT) AS whole, count(*) AS n FROM broker_results GROUP BY 1")
def V4_coerce(spark, d):
    return table(spark, d, "broker_results", "price").groupBy(validate.coerce(F.col("price"), "integer").alias("whole")).agg(F.count("*").alias("n"))


@query("SELECT result_id, list_filter([CASE WHEN price IS NULL OR trim(price) = '' THEN 'price' END, CASE WHEN title IS NULL OR trim(title) = '' THEN 'title' END, CASE WHEN image_url IS NULL OR trim(image_url) = '' THEN 'image_url' END], lambda x: x IS NOT NULL) AS missing FROM broker_results")
def V5_required(spark, d):
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.trim(f) == ""), F.lit(f)) for f in ("price", "title", "image_url")]))
    return table(spark, d, "broker_results").select("result_id", missing.alias("missing"))


@query("SELECT result_id, list_filter([CASE WHEN price IS NOT NULL AND title IS NULL THEN 'price depends title' END, CASE WHEN (price IS NULL) <> (image_url IS NULL) THEN 'price mutually_required image_url' END], lambda x: x IS NOT NULL) AS errors FROM broker_results")
def V6_relations(spark, d):
    return table(spark, d, "broker_results").select("result_id", validate.errors(validate.relation("depends", "price", "title"), validate.relation("mutually_required", "price", "image_url")).alias("errors"))


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def J1_enrich(spark, d):
    # nation and region are fixed reference tables of 25 and 5 rows.
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    out = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    return out.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.col("r_name").alias("region"))


@query("SELECT c_mktsegment, count(DISTINCT o_orderkey) AS orders, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment")
def J5_parent_child(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    out = orders.join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return out.groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.round(F.sum("revenue"), 2).alias("revenue"))


@query(rf"SELECT {HOST.format('url')} AS host FROM search_results EXCEPT SELECT {HOST.format('url')} FROM documents")
def J6_unseen_hosts(spark, d):
    hosts = lambda n: table(spark, d, n, "url").select(urls.host(F.col("url")).alias("host"))
    return dedup.unseen(hosts("search_results").filter("host is not null").distinct(), hosts("documents"), "host")


@query("SELECT url, count(*) FILTER (WHERE prev IS NOT NULL AND prev <> h) AS n_changes, count(*) AS n FROM (SELECT url, h, lag(h) OVER (PARTITION BY url ORDER BY captured_at, content_id) AS prev FROM (SELECT DISTINCT content_id, url, captured_at, md5(coalesce(content, '')) AS h FROM scraped_content)) GROUP BY url")
def J10_content_changes(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("url").orderBy("captured_at", "content_id")
    df = table(spark, d, "scraped_content").select("content_id", "url", "captured_at", F.md5(F.coalesce("content", F.lit(""))).alias("h")).distinct().withColumn("prev", F.lag("h").over(w))
    return df.groupBy("url").agg(F.count_if(F.col("prev").isNotNull() & (F.col("prev") != F.col("h"))).alias("n_changes"), F.count("*").alias("n"))


@query("""WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q, vec_id, list_cosine_similarity(e, embedding)::DOUBLE AS sim FROM q CROSS JOIN embeddings WHERE vec_id <> q)
  SELECT q, vec_id, rank FROM (SELECT q, vec_id, row_number() OVER (PARTITION BY q ORDER BY round(sim, 6) DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def J12_vector_topk(spark, d):
    """Queries are the rows whose id is divisible by 50, in blocks, against all rows; each task keeps the best of its rows."""
    from loomwork.operators import vectors

    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return vectors.top_k(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5)


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value >= 50) AS ok, count(*) - count(*) FILTER (WHERE value >= 50) AS failed, round(count(*) FILTER (WHERE value >= 50) / count(*), 6) AS success_rate, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY event_type")
def A1_rates(spark, d):
    out = metrics.rates(table(spark, d, "events"), ["event_type"], F.coalesce(F.col("value") >= 50, F.lit(False)), F.col("value"))
    return out.withColumns({"success_rate": F.round("success_rate", 6), "avg_value": F.round("avg_value", 6)})


@query(rf"SELECT count(DISTINCT url) AS urls, count(DISTINCT {HOST.format('url')}) AS hosts, round(avg(relevance_score), 6) AS avg_score FROM search_results")
def A2_distinct(spark, d):
    return table(spark, d, "search_results").agg(F.count_distinct("url").alias("urls"), F.count_distinct(urls.host(F.col("url"))).alias("hosts"), F.round(F.avg("relevance_score"), 6).alias("avg_score"))


@query("SELECT domain, count(*) AS n, round(avg(relevance_score), 6) AS score FROM search_results WHERE domain IS NOT NULL GROUP BY domain ORDER BY n DESC, domain LIMIT 20")
def A3_top_domains(spark, d):
    return table(spark, d, "search_results").filter("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg("relevance_score"), 6).alias("score")).orderBy(F.desc("n"), "domain").limit(20)


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, grouping(event_type) + 2 * grouping(date_trunc('hour', ts)) AS level FROM events GROUP BY GROUPING SETS ((event_type), (date_trunc('hour', ts)), ())")
def A5_overall(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    out = e.groupingSets([[F.col("event_type")], [F.col("hour")], []], F.col("event_type"), F.col("hour")).agg(F.count("*").alias("n"), F.grouping("event_type").alias("ge"), F.grouping("hour").alias("gh"))
    return out.select("event_type", "hour", "n", (F.col("ge") + 2 * F.col("gh")).cast("bigint").alias("level"))


@query("SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS median, min(value) AS low, max(value) AS high, count(value) AS n FROM events GROUP BY event_type")
def A7_operation_stats(spark, d):
    """The upper median, found by counts of value ranges."""
    return metrics.value_at(table(spark, d, "events"), "event_type", "value", lambda n: F.floor(n / 2) + 1).select("event_type", F.col("at").alias("median"), "low", "high", "n")


@query("SELECT event_type, list_sort(list(value))[trunc(count(value) * 0.95)::INT + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type HAVING count(value) >= 20")
def A25_p95(spark, d):
    return metrics.value_at(table(spark, d, "events"), "event_type", "value", lambda n: F.floor(n * 0.95) + 1).filter("n >= 20").select("event_type", F.col("at").alias("p95"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, list_sort(list(DISTINCT user_id % 5)) AS classes FROM events GROUP BY event_type")
def A9_breakdown(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.array_sort(F.collect_set(F.col("user_id") % 5)).alias("classes"))


@query("SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE r = 1")
def A10_most_common(spark, d):
    c = table(spark, d, "documents", "source", "lang").filter("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return dedup.first_by(c, ["source"], [-F.col("n"), F.col("lang")]).select("source", "lang")


@query("SELECT source, round(avg(n_chars), 6) AS mean, min(n_chars) AS low, max(n_chars) AS high, round(stddev_pop(n_chars), 6) AS sd FROM documents GROUP BY source")
def A12_distribution(spark, d):
    c = "n_chars"
    return table(spark, d, "documents", "source", c).groupBy("source").agg(F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.stddev_pop(c), 6).alias("sd"))


@query("SELECT CASE WHEN relevance_score >= 0.9 THEN 'excellent' WHEN relevance_score >= 0.7 THEN 'good' WHEN relevance_score >= 0.5 THEN 'fair' ELSE 'poor' END AS bucket, count(*) AS n FROM search_results GROUP BY 1")
def A13_quality_buckets(spark, d):
    s = F.col("relevance_score")
    return table(spark, d, "search_results").groupBy(F.when(s >= 0.9, "excellent").when(s >= 0.7, "good").when(s >= 0.5, "fair").otherwise("poor").alias("bucket")).agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, count(CASE WHEN trim({f}::VARCHAR) <> '' THEN 1 END) AS present, count(*) - count(CASE WHEN trim({f}::VARCHAR) <> '' THEN 1 END) AS missing, round(count(CASE WHEN trim({f}::VARCHAR) <> '' THEN 1 END) / count(*), 6) AS rate FROM broker_results" for f in ("title", "price", "image_url", "full_text")))
def A16_presence(spark, d):
    return metrics.presence(table(spark, d, "broker_results"), ["title", "price", "image_url", "full_text"]).withColumn("rate", F.round("rate", 6))


@query("SELECT 'p_brand' AS field, count(*) AS total, count(DISTINCT p_brand) AS n_distinct, round(entropy(p_brand), 6) AS entropy FROM part")
def A19_entropy(spark, d):
    return metrics.entropy(table(spark, d, "part"), "p_brand").withColumn("entropy", F.round("entropy", 6))


@query("SELECT signature, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN title IS NOT NULL THEN 'title' END, CASE WHEN price IS NOT NULL THEN 'price' END, CASE WHEN image_url IS NOT NULL THEN 'image_url' END], lambda x: x IS NOT NULL), ',') AS signature FROM broker_results) GROUP BY signature")
def A22_signatures(spark, d):
    sig = F.concat_ws(",", *[F.when(F.col(f).isNotNull(), F.lit(f)) for f in ("title", "price", "image_url")])
    return table(spark, d, "broker_results").groupBy(sig.alias("signature")).agg(F.count("*").alias("n"))


@query(rf"""SELECT source, word, n, rank FROM (SELECT source, word, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, word) AS rank FROM
  (SELECT source, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2 AND w NOT IN ({", ".join(repr(w) for w in T.STOP_WORDS)}))) AS word FROM documents) GROUP BY source, word) WHERE rank <= 10""")
def A28_keywords(spark, d):
    tokens = F.filter(T.words(F.col("text")), lambda w: (F.length(w) > 2) & ~w.isin(T.STOP_WORDS))
    return metrics.top_words(table(spark, d, "documents", "source", "text"), "source", tokens, 10)


@query("SELECT hit_id, row_number() OVER (ORDER BY coalesce(relevance_score, 0) * 0.7 + 0.3 / ranking DESC, hit_id) AS rank FROM search_results ORDER BY rank LIMIT 100")
def W1_rank(spark, d):
    """A top-k report: the order is global, so the best rows are taken first and numbered afterwards."""
    from pyspark.sql import Window

    s = table(spark, d, "search_results").withColumn("s", F.coalesce("relevance_score", F.lit(0)) * 0.7 + F.lit(0.3) / F.col("ranking"))
    best = s.orderBy(F.desc("s"), "hit_id").limit(100)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "hit_id"))).select("hit_id", "rank")


@query("""WITH z AS (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT event_id, round(CASE WHEN n >= 4 AND s > 0 THEN (value - m) / s END, 4) AS z FROM z""")
def W2_zscore(spark, d):
    return metrics.zscore(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("z", 4).alias("z"))


@query("SELECT url, max(hit_id) AS hit_id FROM (SELECT hit_id, lower(url) AS url, row_number() OVER (PARTITION BY lower(url) ORDER BY captured_at, hit_id) AS r FROM search_results) WHERE r = 1 GROUP BY url")
def W5_first_seen(spark, d):
    df = table(spark, d, "search_results", "hit_id", "url", "captured_at").withColumn("url", F.lower("url"))
    return dedup.first_by(df, ["url"], [F.col("captured_at"), F.col("hit_id")]).select("url", "hit_id")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, avg(CASE WHEN value >= 50 THEN 0 ELSE 1 END) AS r FROM events GROUP BY 1), l AS (SELECT hour, r, lag(r) OVER (ORDER BY hour) AS p FROM h)
  SELECT hour, CASE WHEN p IS NULL THEN 'insufficient_data' WHEN r < p - 0.05 THEN 'improving' WHEN r > p + 0.05 THEN 'degrading' ELSE 'stable' END AS trend FROM l""")
def W7_trend(spark, d):
    from pyspark.sql import Window

    h = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.avg(F.when(F.col("value") >= 50, 0).otherwise(1)).alias("r"))
    p = F.lag("r").over(Window.orderBy("hour"))  # one row per hour of the log
    return h.select("hour", F.when(p.isNull(), "insufficient_data").when(F.col("r") < p - 0.05, "improving").when(F.col("r") > p + 0.05, "degrading").otherwise("stable").alias("trend"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def W9_trailing_count(spark, d):
    return metrics.trailing_count(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "recent")


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank FROM events) WHERE rank <= 3")
def O4_top_per_key(spark, d):
    return dedup.per_key_rank(table(spark, d, "events"), ["user_id"], [F.desc_nulls_last("value"), F.col("event_id")], 3).select("user_id", "event_id", "rank")


@query("SELECT sha256(lower(trim(title)) || '|' || coalesce(lower(trim(domain)), '')) AS key, count(*) AS merge_count, min_by(nullif(trim(snippet), ''), hit_id) FILTER (WHERE trim(snippet) <> '') AS snippet, min_by(relevance_score, hit_id) FILTER (WHERE relevance_score IS NOT NULL) AS relevance_score FROM search_results GROUP BY 1")
def U1_combine(spark, d):
    key = F.sha2(F.concat(F.lower(F.trim("title")), F.lit("|"), F.coalesce(F.lower(F.trim("domain")), F.lit(""))), 256)
    df = table(spark, d, "search_results").withColumn("key", key).withColumn("snippet", F.trim("snippet"))
    return dedup.merge_fill(df, ["key"], F.col("hit_id"), ["snippet", "relevance_score"])


@query("SELECT 'documents' AS origin, url, doc_id AS id FROM documents UNION ALL SELECT 'pages', url, page_id FROM page_data UNION ALL SELECT 'scraped', url, content_id FROM scraped_content")
def U2_concat(spark, d):
    parts = [table(spark, d, n, "url", i).select(F.lit(o).alias("origin"), "url", F.col(i).alias("id")) for o, n, i in (("documents", "documents", "doc_id"), ("pages", "page_data", "page_id"), ("scraped", "scraped_content", "content_id"))]
    return dedup.concat_sources(parts)


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY coalesce(md5(text), doc_id::VARCHAR) ORDER BY doc_id) AS r FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY coalesce(url, doc_id::VARCHAR) ORDER BY doc_id) AS q FROM a WHERE r = 1) SELECT doc_id FROM b WHERE q = 1")
def U3_hash_then_url(spark, d):
    df = table(spark, d, "documents", "doc_id", "text", "url").select("doc_id", "url", F.md5("text").alias("h"))
    return dedup.first_by(dedup.first_by(df, ["h"], [F.col("doc_id")]), ["url"], [F.col("doc_id")]).select("doc_id")


@query("SELECT url, hit_id, relevance_score FROM (SELECT lower(url) AS url, hit_id, relevance_score, row_number() OVER (PARTITION BY lower(url) ORDER BY relevance_score DESC NULLS LAST, hit_id) AS r FROM search_results) WHERE r = 1")
def U5_best_per_url(spark, d):
    df = table(spark, d, "search_results", "hit_id", "url", "relevance_score").withColumn("url", F.lower("url"))
    return dedup.first_by(df, ["url"], [F.col("relevance_score").isNull(), -F.col("relevance_score"), F.col("hit_id")])


@query("SELECT result_id, CASE WHEN trim(title) <> '' THEN 'title:' || lower(trim(title)) WHEN trim(detail_url) <> '' THEN 'url:' || lower(trim(detail_url)) END AS key FROM broker_results")
def U6_identity(spark, d):
    return table(spark, d, "broker_results").select("result_id", dedup.identity_key(("title", F.col("title")), ("url", F.col("detail_url"))).alias("key"))


@query("""SELECT k, count(*) AS merge_count, arg_max(full_text, (length(full_text), full_text)) AS full_text, arg_max(price, (result_id, price)) FILTER (WHERE price IS NOT NULL) AS price FROM (SELECT *, lower(detail_url) AS k FROM broker_results) GROUP BY k""")
def U19_survivorship(spark, d):
    df = table(spark, d, "broker_results").withColumn("k", F.lower("detail_url"))
    return dedup.survivorship(df, ["k"], {"full_text": F.length("full_text"), "price": F.col("result_id")})


@query("SELECT p_partkey, coalesce(a.p_name, b.p_name) AS p_name, coalesce(a.p_size, b.p_size) AS p_size FROM (SELECT p_partkey, upper(p_name) AS p_name, NULL::INT AS p_size FROM part WHERE p_partkey % 2 = 0) a FULL JOIN (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 = 0) b USING (p_partkey)")
def K8_upsert(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    new = p.filter("p_partkey % 2 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), F.lit(None).cast("int").alias("p_size"))
    return dedup.upsert(p.filter("p_partkey % 3 = 0"), new, "p_partkey", ["p_name", "p_size"])


@query("SELECT item_id, price.amount AS price_amount, price.currency AS price_currency, rating.count AS rating_count FROM (SELECT DISTINCT item_id, price, rating FROM listing_items)")
def K10_flatten(spark, d):
    out = project.flatten(table(spark, d, "listing_items", "item_id", "price", "rating").distinct())
    return out.select("item_id", "price_amount", "price_currency", "rating_count")


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1")
def R1_buckets(spark, d):
    out = metrics.buckets(table(spark, d, "events"), "ts", "5 minutes", [], [F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value")])
    return out.select("bucket", "n", "avg_value")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def R6_sessions(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("started"), "n")
