"""Text, address and value functions over the test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.functions import urls as L
from loomwork.functions import values as N
from loomwork.operators import units
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


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


WS = r"[\s\x{00A0}]+"


def clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def sents(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '[.!?]+'), lambda s: {clean('s')}), lambda s: s <> '')"


SYLL = "greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN regexp_matches(w, '[^aeiouy]e$') THEN 1 ELSE 0 END)"
FLESCH = f"CASE WHEN len({words('text')}) > 0 THEN 206.835 - 1.015 * len({words('text')}) / greatest(1, len({sents('text')})) - 84.6 * list_sum(list_transform({words('text')}, lambda w: {SYLL})) / len({words('text')}) END"


@query(f"SELECT doc_id, md5({clean('text')}) AS digest FROM documents")
def T1_clean_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_whitespace(F.col("text"))).alias("digest"))


@query(r"SELECT content_id, length(regexp_replace(content, '[\x00-\x1f\x7f-\x{9f}]', '', 'g')) AS n FROM scraped_content")
def T2_control_chars(spark, d):
    return table(spark, d, "scraped_content").select("content_id", F.length(T.remove_control_chars(F.col("content"))).cast("bigint").alias("n"))


@query("SELECT result_id, replace(translate(title, '‘’“”–', '''''\"\"-'), '—', '--') AS title FROM broker_results")
def T3_straight_quotes(spark, d):
    return table(spark, d, "broker_results").select("result_id", T.straight_quotes(F.col("title")).alias("title"))


@query(f"SELECT hit_id, {clean('''regexp_replace('<p class=x><b>' || title || '</b></p>', '<[^>]*>', ' ', 'g')''')} AS plain FROM search_results")
def T4_strip_tags(spark, d):
    html = F.concat(F.lit("<p class=x><b>"), F.col("title"), F.lit("</b></p>"))
    return table(spark, d, "search_results").select("hit_id", T.strip_tags(html).alias("plain"))


@query("SELECT hit_id, array_to_string(list_filter(string_split(" + clean(r"regexp_replace(lower(query_text), '[^\p{L}\p{N}\s]', ' ', 'g')") + f", ' '), lambda w: w NOT IN {_in(T.STOP_WORDS)}), ' ') AS term FROM search_results")
def T8_search_term(spark, d):
    return table(spark, d, "search_results").select("hit_id", T.search_term(F.col("query_text")).alias("term"))


@query("SELECT hit_id, regexp_replace(regexp_replace(lower(query_text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM search_results")
def T9_slug(spark, d):
    return table(spark, d, "search_results").select("hit_id", T.slug(F.col("query_text")).alias("slug"))


@query(f"SELECT doc_id, len({sents('text')}) AS n, {sents('text')}[1] AS first FROM documents")
def T10_sentences(spark, d):
    s = T.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.size(s)).cast("bigint").alias("n"), F.get(s, 0).alias("first"))


@query("SELECT source, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY source")
def T11_token_estimate(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query(f"""WITH s AS (SELECT doc_id, unnest({sents('text')}) AS s, generate_subscripts({sents('text')}, 1) AS k FROM documents),
  c AS (SELECT *, sum(length(s) // 4 + 1) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM s)
  SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(c.s || '.', ' ' ORDER BY c.k) FILTER (WHERE c.n <= 100), '') END AS head
  FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id, d.text""")
def T12_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate_sentences(F.col("text"), 100).alias("head"))


@query(f"""SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_unique, len(s) AS n_sentences,
  round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) END, 6) AS avg_word_length, round(CASE WHEN len(s) > 0 THEN len(w) / len(s) END, 6) AS avg_sentence_length
  FROM (SELECT doc_id, {words('text')} AS w, {sents('text')} AS s FROM documents WHERE text IS NOT NULL)""")
def T17_text_stats(spark, d):
    s = table(spark, d, "documents").filter("text is not null").select("doc_id", T.text_stats(F.col("text")).alias("s"))
    counts = [F.col(f"s.{x}").cast("bigint").alias(x) for x in ("n_words", "n_unique", "n_sentences")]
    return s.select("doc_id", *counts, *[F.round(f"s.{x}", 6).alias(x) for x in ("avg_word_length", "avg_sentence_length")])


@query(f"SELECT doc_id, round({FLESCH}, 6) AS flesch FROM documents WHERE text IS NOT NULL")
def T18_flesch(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.round(T.flesch(F.col("text")), 6).alias("flesch"))


@query(f"""WITH m AS (SELECT doc_id, text, len(list_filter({words('text')}, lambda w: w IN {_in(T.POSITIVE)})) - len(list_filter({words('text')}, lambda w: w IN {_in(T.NEGATIVE)})) AS m FROM documents)
  SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(text) < 50 THEN 'neutral' WHEN m > 2 THEN 'positive' WHEN m < -2 THEN 'negative' ELSE 'neutral' END AS tone FROM m""")
def T20_sentiment(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sentiment(F.col("text")).alias("tone"))


@query(f"""SELECT hit_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS sim
  FROM (SELECT hit_id, {words('query_text')} AS a, {words('title')} AS b FROM search_results)""")
def T22_jaccard(spark, d):
    return table(spark, d, "search_results").select("hit_id", F.round(T.jaccard(F.col("query_text"), F.col("title")), 6).alias("sim"))


@query(f"""WITH p AS (SELECT doc_id, length(text) AS n, text, {words('text')} AS w, {sents('text')} AS s, {FLESCH} AS f FROM documents WHERE text IS NOT NULL),
  q AS (SELECT doc_id, n, CASE WHEN n < 50 THEN 0.1 WHEN n < 200 THEN 0.5 WHEN n < 500 THEN 0.7 WHEN n < 2000 THEN 1.0 WHEN n < 5000 THEN 0.8 ELSE 0.6 END AS a,
    CASE WHEN contains(text, chr(10) || chr(10)) THEN 0.3 ELSE 0 END + CASE WHEN len(s) > 2 THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(text, '[A-Z]') THEN 0.3 ELSE 0 END AS b,
    CASE WHEN len(w) > 0 THEN 0.7 * len(list_distinct(w)) / len(w) ELSE 0 END + 0.3 * least(5 * length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(1, n), 1) AS c, coalesce(least(1, greatest(0, f / 100)), 0) AS e FROM p)
  SELECT doc_id, round(CASE WHEN n < 10 THEN 0 ELSE 0.25 * a + 0.25 * b + 0.25 * c + 0.25 * e END, 6)::DOUBLE AS quality FROM q""")
def Q1_quality(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.round(T.quality(F.col("text"))["quality"], 6).alias("quality"))


HOST = r"regexp_replace(regexp_extract(lower(trim({0})), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '')"
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
PARAMS = r"list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+$'))"


@query(rf"""WITH p AS (SELECT hit_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS s, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '(:80|:443)$', '') AS a, {PATH} AS p,
  array_to_string(list_filter({PARAMS}, lambda p: lower(split_part(p, '=', 1)) NOT IN {_in(L.TRACKING)}), '&') AS q FROM search_results)
  SELECT hit_id, s || '://' || a || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM p""")
def L1_canonical(spark, d):
    return table(spark, d, "search_results").select("hit_id", L.canonical(F.col("url")).alias("url"))


@query(rf"""SELECT page_id, len(list_filter(string_split({PATH}, '/'), lambda s: s <> '')) AS depth, len({PARAMS}) AS n_params,
  CASE WHEN regexp_matches(lower({PATH}), '\.(jpg|jpeg|png|gif|svg|mp4|pdf|zip)$') THEN 'media' WHEN {PATH} IN ('', '/') THEN 'home' WHEN regexp_matches(lower({PATH}), '/(search|category|tag|list|page)(/|$)') THEN 'listing'
  WHEN regexp_matches(lower({PATH}), '[-/]\d+/?$') THEN 'detail' ELSE 'page' END AS kind FROM page_data""")
def L2_classify(spark, d):
    u = F.col("url")
    return table(spark, d, "page_data").select("page_id", L.depth(u).cast("bigint").alias("depth"), F.size(L.params(u)).cast("bigint").alias("n_params"), L.kind(u).alias("kind"))


@query(f"SELECT {HOST.format('url')} AS host, count(*) AS n FROM page_data GROUP BY 1")
def L3_hosts(spark, d):
    return table(spark, d, "page_data").groupBy(L.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(rf"SELECT result_id, lower(regexp_extract(detail_url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme, {HOST.format('detail_url')} AS host, regexp_extract(detail_url, '^[^?#]*\?([^#]*)', 1) AS query FROM broker_results")
def L5_parts(spark, d):
    return table(spark, d, "broker_results").select("result_id", L.parts(F.col("detail_url")).alias("p")).select("result_id", "p.scheme", "p.host", "p.query")


@query("SELECT hit_id, round(least(1, greatest(0, CASE WHEN contains(lower(url), 'garden') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(url), 'kitchen') THEN 0.3 ELSE 0 END - CASE WHEN contains(lower(url), 'page=') THEN 0.2 ELSE 0 END)), 6)::DOUBLE AS score FROM search_results")
def L6_keyword_score(spark, d):
    return table(spark, d, "search_results").select("hit_id", F.round(L.keyword_score(F.col("url"), ["garden", "kitchen"], ["page="]), 6).alias("score"))


@query(rf"SELECT {HOST.format('url')} || CASE WHEN regexp_extract({PATH}, '^/([^/]+)', 1) = '' THEN '' ELSE '/' || regexp_extract({PATH}, '^/([^/]+)', 1) END AS pattern, count(*) AS n FROM scraped_content GROUP BY 1")
def L9_site_pattern(spark, d):
    return table(spark, d, "scraped_content").groupBy(L.site_pattern(F.col("url")).alias("pattern")).agg(F.count("*").alias("n"))


@query(r"SELECT hit_id, try_cast(regexp_replace(query_text || ' 1' || hit_id || '.5 km', '[^\d.\-]', '', 'g') AS DOUBLE) AS x FROM search_results")
def N7_number(spark, d):
    return table(spark, d, "search_results").select("hit_id", N.to_number(F.concat(F.col("query_text"), F.lit(" 1"), F.col("hit_id"), F.lit(".5 km"))).alias("x"))


@query(f"SELECT hit_id, CASE WHEN lower(trim(v)) IN {_in(N.TRUE_WORDS)} THEN true WHEN lower(trim(v)) IN {_in(N.FALSE_WORDS)} THEN false END AS b FROM (SELECT hit_id, CASE hit_id % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'OFF' WHEN 2 THEN 'in stock' ELSE 'maybe' END AS v FROM search_results)")
def N8_boolean(spark, d):
    v = F.expr("CASE hit_id % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'OFF' WHEN 2 THEN 'in stock' ELSE 'maybe' END")
    return table(spark, d, "search_results").select("hit_id", N.to_boolean(v).alias("b"))


@query("""SELECT o_orderkey, o_orderdate::DATE AS parsed FROM orders""")
def N1_date(spark, d):
    t = F.col("o_orderdate")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(t, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(t, "MMMM d, yyyy")).otherwise(F.date_format(t, "yyyyMMdd"))
    return table(spark, d, "orders").select("o_orderkey", N.to_date(shown).alias("parsed"))


@query("SELECT p_partkey, round(p_size * CASE p_partkey % 3 WHEN 0 THEN 0.0254 WHEN 1 THEN 0.01 ELSE 1609.344 END, 6)::DOUBLE AS metres FROM part")
def N9_units(spark, d):
    df = table(spark, d, "part").withColumn("u", F.expr("CASE p_partkey % 3 WHEN 0 THEN 'in' WHEN 1 THEN 'cm' ELSE 'mi' END"))
    return units.convert(df, "p_size", "u", N.UNIT_EDGES, "m", "metres").select("p_partkey", F.round("metres", 6).alias("metres"))


@query(r"""SELECT content_id, regexp_full_match(url, 'https?://[^\s/?#]+\.[^\s]+') AS url_ok, regexp_full_match(coalesce(error_message, ''), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') AS mail_ok FROM scraped_content""")
def N10_validators(spark, d):
    return table(spark, d, "scraped_content").select("content_id", N.is_url(F.col("url")).alias("url_ok"), N.is_email(F.coalesce("error_message", F.lit(""))).alias("mail_ok"))


@query("""SELECT hit_id, (list_sum(list_transform(range(1, 14), lambda i: substr(v, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0) AS ok FROM (SELECT hit_id, '978' || lpad(hit_id::VARCHAR, 10, '0') AS v FROM search_results)""")
def N12_isbn(spark, d):
    return table(spark, d, "search_results").select("hit_id", N.isbn13_valid(F.concat(F.lit("978-"), F.lpad(F.col("hit_id").cast("string"), 10, "0"))).alias("ok"))


@query(r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN v IS NULL OR trim(v) = '' THEN 'empty' WHEN regexp_full_match(trim(v), '-?\d+') THEN 'integer' WHEN regexp_full_match(trim(v), '-?\d*\.\d+') THEN 'number' WHEN lower(trim(v)) IN ('true', 'false') THEN 'boolean'
  WHEN regexp_matches(trim(v), '^\d{4}-\d{2}-\d{2}') THEN 'date' WHEN regexp_full_match(trim(v), 'https?://[^\s/?#]+\.[^\s]+') THEN 'url' WHEN regexp_full_match(trim(v), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') THEN 'email'
  WHEN regexp_full_match(trim(v), '[\[{].*[\]}]') THEN 'json' ELSE 'text' END AS kind FROM (SELECT price AS v FROM broker_results UNION ALL SELECT url FROM search_results UNION ALL SELECT metadata FROM search_results)) GROUP BY kind""")
def N14_types(spark, d):
    s = table(spark, d, "search_results")
    v = table(spark, d, "broker_results").select(F.col("price").alias("v")).unionAll(s.select("url")).unionAll(s.select("metadata"))
    return v.groupBy(N.inferred_type(F.col("v")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT hit_id, len(list_filter(list_transform(string_split(title, ','), lambda x: trim(x)), lambda x: x <> '')) AS n FROM search_results")
def C1_split_list(spark, d):
    return table(spark, d, "search_results").select("hit_id", F.size(N.split_list(F.col("title"))).cast("bigint").alias("n"))


@query("SELECT page_id, json_extract_string(structured_data, '$.type') AS kind, json_extract_string(structured_data, '$.headings[0]') AS heading, json_extract_string(metadata, '$.lang') AS lang FROM page_data")
def C2_nested_get(spark, d):
    return table(spark, d, "page_data").select("page_id", F.get_json_object("structured_data", "$.type").alias("kind"), F.get_json_object("structured_data", "$.headings[0]").alias("heading"), F.get_json_object("metadata", "$.lang").alias("lang"))


@query("SELECT hit_id, md5(array_to_string(list_sort(list_transform(json_keys(metadata), lambda k: k || '=' || coalesce(json_extract_string(metadata, k), 'null'))), ',')) AS digest FROM search_results")
def C4_canonical_json(spark, d):
    return table(spark, d, "search_results").select("hit_id", F.md5(N.canonical_json(F.col("metadata"))).alias("digest"))


@query(r"SELECT result_id, len(list_distinct(regexp_extract_all(full_text, '\d+ square feet'))) AS areas, len(regexp_extract_all(full_text, '\b\d{3}-\d{4}\b')) AS phones FROM broker_results")
def H14_patterns(spark, d):
    t = F.col("full_text")
    areas = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\d+ square feet)"))))
    return table(spark, d, "broker_results").select("result_id", areas.cast("bigint").alias("areas"), F.size(F.regexp_extract_all(t, F.lit(r"\b(\d{3}-\d{4})\b"))).cast("bigint").alias("phones"))
