"""Similar rows, groups, merges, identifiers, names and further scores."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import parties as P
from loomwork.functions import text as T
from loomwork.operators import dedup, similar, units
from loomwork.operators.rules import RuleSet
from loomwork.plans.lineage import cut
from loomwork.queries.data import _P1
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


_SETS = r"""
  rows AS (SELECT DISTINCT hit_id AS row_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda w: w <> ''))) AS words FROM search_results WHERE title IS NOT NULL),
  sets AS (SELECT min(row_id) AS rep, words FROM rows WHERE len(words) > 0 GROUP BY words),
  tokens AS (SELECT rep, len(words) AS n, unnest(words) AS w FROM sets),
  shared AS (SELECT a.rep AS rep_a, b.rep AS rep_b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM tokens a JOIN tokens b USING (w) WHERE a.rep < b.rep GROUP BY a.rep, b.rep),
  pairs AS (SELECT rep_a, rep_b, k / (na + nb - k) AS similarity FROM shared WHERE k / (na + nb - k) >= 0.8 - 1e-9)"""


def _titles(spark: SparkSession, d: str) -> similar.WordSets:
    return similar.WordSets(table(spark, d, "search_results", "hit_id", "title"), "hit_id", F.col("title"), 0.8)


@query(f"WITH {_SETS} SELECT rep_a, rep_b, round(similarity, 6) AS similarity FROM pairs")
def J3_similar_titles(spark, d):
    return _titles(spark, d).pairs().withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {_SETS},
  ends AS (SELECT rep_a AS a, rep_b AS b FROM pairs UNION SELECT rep_b, rep_a FROM pairs),
  reach AS (SELECT rep AS a, rep AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b),
  named AS (SELECT a AS rep, min(b) AS group_id FROM reach GROUP BY a)
  SELECT r.row_id, s.rep AS class_id, n.group_id, (SELECT count(*) FROM ends e WHERE e.a = s.rep) AS n_links FROM rows r JOIN sets s USING (words) JOIN named n USING (rep)""")
def J4_title_groups(spark, d):
    """One row per hit: its class of equal word sets, its group of linked classes and the number of its class's links."""
    return _titles(spark, d).groups()


def _weighted_sql(fields: list[tuple[str, float]]) -> str:
    words = lambda c: rf"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"
    filled = {f: f"(coalesce(trim(a.{f}), '') <> '' AND coalesce(trim(b.{f}), '') <> '')" for f, _ in fields}
    part = lambda f: f"coalesce(len(list_intersect({words(f'a.{f}')}, {words(f'b.{f}')})) / nullif(len(list_distinct(list_concat({words(f'a.{f}')}, {words(f'b.{f}')}))), 0), 0)"
    top = " + ".join(f"CASE WHEN {filled[f]} THEN {w} * {part(f)} ELSE 0 END" for f, w in fields)
    weight = " + ".join(f"CASE WHEN {filled[f]} THEN {w} ELSE 0 END" for f, w in fields)
    return f"({top}) / nullif({weight}, 0)"


_WEIGHTS = [("title", 0.5), ("snippet", 0.3), ("query_text", 0.2)]


@query(f"""WITH {_SETS}, scored AS (SELECT rep_a, rep_b, {_weighted_sql(_WEIGHTS)} AS s FROM pairs JOIN search_results a ON a.hit_id = rep_a JOIN search_results b ON b.hit_id = rep_b)
  SELECT rep_a, rep_b, round(s, 6) AS similarity, CASE WHEN s >= 0.95 THEN 'exact' WHEN s >= 0.85 THEN 'near' WHEN s >= 0.7 THEN 'semantic' WHEN s IS NOT NULL THEN 'partial' END AS label FROM scored""")
def J2_weighted_pairs(spark, d):
    """Class pairs of like titles with their similarity over several fields."""
    hits = table(spark, d, "search_results", "hit_id", *[f for f, _ in _WEIGHTS])
    pairs = cut(_titles(spark, d).pairs().select("rep_a", "rep_b"))
    hits = similar.narrowed(hits, "hit_id", similar.ends(pairs))
    a, b = (hits.select(*[F.col(c).alias(f"{c}_{s}") for c in hits.columns]) for s in "ab")
    both = pairs.join(a, F.col("rep_a") == F.col("hit_id_a")).join(b, F.col("rep_b") == F.col("hit_id_b"))
    s = similar.weighted({f: (w, F.col(f"{f}_a"), F.col(f"{f}_b")) for f, w in _WEIGHTS})
    return both.select("rep_a", "rep_b", s.alias("s")).select("rep_a", "rep_b", F.round("s", 6).alias("similarity"), similar.label(F.col("s")).alias("label"))


@query("""SELECT lower(trim(brand)) AS k, list_sort(list_distinct(flatten(list(features) FILTER (WHERE features IS NOT NULL)))) AS features, list_sort(list(DISTINCT seller)) AS sources,
  min_by(category, item_id) FILTER (WHERE trim(category) <> '') AS category, max(rating.value) AS score FROM listing_items WHERE trim(brand) <> '' GROUP BY 1""")
def U9_complementary_merge(spark, d):
    """Lists are united, empty fields filled from the first row that has one, sources kept as a set, scores by their greatest."""
    df = table(spark, d, "listing_items", "item_id", "brand", "features", "seller", "category", "rating").filter("trim(brand) <> ''").withColumn("k", F.lower(F.trim("brand")))
    rest = df.groupBy("k").agg(F.array_sort(F.collect_set("seller")).alias("sources"), F.min_by("category", F.when(F.trim("category") != "", F.col("item_id"))).alias("category"), F.max("rating.value").alias("score"))
    lists = df.filter("features is not null").select("k", F.explode_outer("features").alias("x")).groupBy("k").agg(F.array_sort(F.collect_set("x")).alias("features"))
    return rest.join(lists, "k", "left").select("k", "features", "sources", "category", "score")


@query("SELECT lower(trim(brand)) AS key, count(DISTINCT seller) AS n_batches FROM listing_items WHERE brand IS NOT NULL AND seller IS NOT NULL GROUP BY 1 HAVING count(DISTINCT seller) >= 2")
def A29_shared_keys(spark, d):
    """Keys that several batches have."""
    df = table(spark, d, "listing_items", "brand", "seller").filter("seller is not null").select(F.lower(F.trim("brand")).alias("key"), "seller")
    return dedup.in_batches(df, "key", "seller", 2)


@query("""WITH n AS (SELECT lower(trim(brand)) AS key, category, count(*) AS k FROM listing_items WHERE brand IS NOT NULL AND category IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(k) OVER (PARTITION BY key) AS total FROM n)
  SELECT key, category FROM r WHERE 2 * k > total""")
def A29_majority(spark, d):
    """The value that more than half of a key's rows agree on."""
    n = table(spark, d, "listing_items", "brand", "category").filter("brand is not null and category is not null").groupBy(F.lower(F.trim("brand")).alias("key"), "category").agg(F.count("*").alias("k"))
    total = n.groupBy("key").agg(F.sum("k").alias("total"), F.max("k").alias("most"))
    return n.join(total.filter("2 * most > total"), "key").filter("k = most").select("key", "category")


@query("""WITH a AS (SELECT json_keys(metadata) AS k, count(*) AS n FROM search_results WHERE metadata IS NOT NULL GROUP BY 1), b AS (SELECT json_keys(structured_data) AS k, count(*) AS n FROM page_data WHERE json_valid(structured_data) GROUP BY 1),
  x AS (SELECT list_distinct(flatten(list(k))) AS k FROM a), y AS (SELECT list_distinct(flatten(list(k))) AS k FROM b)
  SELECT round(len(list_intersect(x.k, y.k)) / len(list_distinct(list_concat(x.k, y.k))), 6) AS similarity FROM x, y""")
def U13_structures(spark, d):
    """Jaccard similarity of all keys that the objects of two tables have."""
    def keys(name: str, c: str, side: str) -> DataFrame:
        return table(spark, d, name, c).select(F.explode(F.json_object_keys(c)).alias("key")).distinct().withColumn("side", F.lit(side))

    both = keys("search_results", "metadata", "a").unionByName(keys("page_data", "structured_data", "b")).groupBy("key").agg(F.count("*").alias("n"))
    return both.agg(F.round(F.count_if(F.col("n") == 2) / F.count("*"), 6).alias("similarity"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  s AS (SELECT user_id, r, sec, true AS ok, 2.0::DOUBLE AS left_over FROM e WHERE r = 1
        UNION ALL SELECT user_id, r, sec, filled >= 1, CASE WHEN filled >= 1 THEN filled - 1 ELSE filled END FROM (SELECT e.user_id, e.r, e.sec, least(3.0, s.left_over + greatest(0.0, e.sec - s.sec) * 0.00001) AS filled FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1))
  SELECT user_id, count(*) FILTER (WHERE NOT ok) AS refused, count(*) AS n FROM s GROUP BY user_id""")
def R5_refusing_bucket(spark, d):
    """A bucket of three tokens, refilled by one in about a day."""
    from loomwork.streaming import token_bucket

    out = token_bucket(table(spark, d, "events"), "user_id", "event_id", "ts", 0.00001, 3.0)
    return out.groupBy(F.col("key").cast("bigint").alias("user_id")).agg(F.count_if(~F.col("allowed")).alias("refused"), F.count("*").alias("n"))


@query("""WITH one AS (SELECT [CASE WHEN title IS NOT NULL THEN 'title' END, CASE WHEN price IS NOT NULL THEN 'price' END, CASE WHEN image_url IS NOT NULL THEN 'image_url' END] AS k, regexp_matches(price, '^[0-9 .,]+$') AS plain FROM broker_results),
  s AS (SELECT list_filter(k, lambda x: x IS NOT NULL) AS k, count(*) AS n FROM one GROUP BY 1), t AS (SELECT sum(n) AS n FROM s),
  p AS (SELECT sum(a.n * b.n * CASE WHEN len(list_distinct(list_concat(a.k, b.k))) = 0 THEN 1 ELSE len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) END) AS x, any_value(t.n) AS n FROM s a, s b, t),
  q AS (SELECT (count(title) + count(price) + count(image_url)) / (3 * count(*)) AS presence, greatest(count(*) FILTER (WHERE price SIMILAR TO '[0-9 .,]+'), count(*) FILTER (WHERE price NOT SIMILAR TO '[0-9 .,]+')) / count(price) AS types FROM broker_results)
  SELECT round(0.4 * presence + 0.3 * types + 0.3 * (x - n) / (n * (n - 1)), 6)::DOUBLE AS consistency FROM p, q""")
def A20_structural_consistency(spark, d):
    """0.4 mean presence + 0.3 share of the most usual kind of value + 0.3 mean Jaccard similarity of the key sets of two rows, by counts of signatures."""
    b = table(spark, d, "broker_results", "title", "price", "image_url")
    plain = F.regexp_like("price", F.lit("^[0-9 .,]+$"))
    q = b.agg(((F.count("title") + F.count("price") + F.count("image_url")) / (3 * F.count("*"))).alias("presence"), (F.greatest(F.count_if(plain), F.count_if(~plain)) / F.count("price")).alias("types"))
    k = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in b.columns]))
    s = b.groupBy(k.alias("k")).agg(F.count("*").alias("n"))  # at most eight signatures
    union = F.size(F.array_union("k", "k2"))
    like = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("k", "k2")) / F.greatest(union, F.lit(1)))
    pairs = s.join(F.broadcast(s.select(F.col("k").alias("k2"), F.col("n").alias("n2"))), F.size("k") + F.size("k2") >= 0)
    p = pairs.agg(F.sum(F.col("n") * F.col("n2") * like).alias("x")).join(s.agg(F.sum("n").alias("n")))
    return p.join(q).select(F.round(0.4 * F.col("presence") + 0.3 * F.col("types") + 0.3 * (F.col("x") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("consistency"))


@query(_P1.replace("SELECT DISTINCT src_table, rec_id, round(amount * times * usd_per_unit * 100 / CASE WHEN small OR (src_table = 'listing_items' AND rec_id IN (SELECT item_id FROM pence)) THEN minor_per_unit ELSE 1 END)::BIGINT AS usd_cents",
                   "SELECT DISTINCT rec_id, round(amount * times, 2) AS amount").replace("WHERE amount > 0", "WHERE amount > 0 AND src_table = 'broker_results'"))
def N5_price_amounts(spark, d):
    """The amount that a price text states, in its own currency."""
    rates = [(r[0], r[1], r[2]) for r in table(spark, d, "currency_rates").collect()]
    out = units.with_money(table(spark, d, "broker_results", "result_id", "price"), "price", units.money_edges(rates))
    factor = F.coalesce(F.create_map(*[x for k, v in units.SCALES.items() for x in (F.lit(k), F.lit(v))])[F.col("money.scale")], F.lit(1.0))
    return out.filter("money.value > 0").select(F.col("result_id").alias("rec_id"), F.round(F.col("money.value") * factor, 2).alias("amount")).distinct()


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS given, split_part(c_name, '#', 2) AS family, 'uuid' AS kind FROM customer")
def N11_names(spark, d):
    """Names are built from the customer's name in the order 'Family, Given'."""
    n = F.concat(F.split_part("c_name", F.lit("#"), F.lit(2)), F.lit(", "), F.split_part("c_name", F.lit("#"), F.lit(1)))
    ident = F.concat_ws("-", F.lpad(F.hex("c_custkey"), 8, "0"), F.lit("1234"), F.lit("4abc"), F.lit("8def"), F.lit("0123456789ab"))
    return table(spark, d, "customer", "c_custkey", "c_name").select("c_custkey", P.name_parts(n)["given"].alias("given"), P.name_parts(n)["family"].alias("family"), P.identifier_kind(ident).alias("kind"))


@query(r"""SELECT doc_id, round(greatest(0, least(1, 1 - abs(w / s - 17) / 30)), 6)::DOUBLE AS readability FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w,
  greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '[\s\x{00A0}]+', ' ', 'g')) <> ''))) AS s FROM documents WHERE text IS NOT NULL)""")
def T19_readability(spark, d):
    """Near 1 for sentences of about 17 words, less the farther from it."""
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.round(T.readability_approx(t), 6).alias("readability"))


@query("SELECT source, round(avg(least(n_chars / 2000, 1)), 6) AS length, round(avg((lang IS NOT NULL)::INT), 6) AS lang, round(avg((url IS NOT NULL)::INT), 6) AS url FROM documents GROUP BY source")
def A14_metric_averages(spark, d):
    one = table(spark, d, "documents", "source", "n_chars", "lang", "url")
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return one.groupBy("source").agg(mean(F.least(F.col("n_chars") / 2000, F.lit(1.0)), "length"), mean(F.col("lang").isNotNull().cast("int"), "lang"), mean(F.col("url").isNotNull().cast("int"), "url"))


_IMPORTANCE = [("title", 0.4), ("price", 0.3), ("full_text", 0.2), ("image_url", 0.1)]


@query(f"SELECT result_id, round({' + '.join(f'{w} * (coalesce(trim({f}), {chr(39) * 2}) <> {chr(39) * 2})::INT' for f, w in _IMPORTANCE)}, 6)::DOUBLE AS completeness FROM broker_results")
def Q18_important_fields(spark, d):
    """Completeness in which each field counts by its importance."""
    score = sum((w * (F.coalesce(F.trim(f), F.lit("")) != "").cast("int") for f, w in _IMPORTANCE), F.lit(0.0))
    return table(spark, d, "broker_results", "result_id", *[f for f, _ in _IMPORTANCE]).select("result_id", F.round(score, 6).alias("completeness"))


@query(r"""SELECT doc_id, round(greatest(0, least(1, 0.5 + CASE WHEN n_chars > 1000 THEN 0.2 WHEN n_chars > 300 THEN 0.1 WHEN n_chars < 100 THEN -0.2 ELSE 0 END + CASE WHEN contains(text, chr(10)) THEN 0.1 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.1 ELSE 0 END - CASE WHEN upper(text) = text THEN 0.2 ELSE 0 END)), 6)::DOUBLE AS score FROM documents WHERE text IS NOT NULL""")
def Q19_content_bands(spark, d):
    """0.5 and a step for each band of length and trait."""
    t, n = F.col("text"), F.col("n_chars")
    s = 0.5 + F.when(n > 1000, 0.2).when(n > 300, 0.1).when(n < 100, -0.2).otherwise(0.0) + F.when(F.contains(t, F.lit("\n")), 0.1).otherwise(0.0) + F.when(t.rlike("[0-9]"), 0.1).otherwise(0.0) - F.when(F.upper(t) == t, 0.2).otherwise(0.0)
    return table(spark, d, "documents", "doc_id", "text", "n_chars").filter("text is not null").select("doc_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 6).alias("score"))


@query("""SELECT result_id, CASE WHEN regexp_matches(price, '(?i)million|mio') THEN 'large' WHEN regexp_matches(price, '[0-9]') AND regexp_matches(full_text, '(?i)square feet') THEN 'measured' WHEN regexp_matches(price, '[0-9]') OR regexp_matches(title, '(?i)sale') THEN 'offer' END AS first_rule,
  list_filter([CASE WHEN regexp_matches(price, '(?i)million|mio') THEN 'large' END, CASE WHEN regexp_matches(price, '[0-9]') AND regexp_matches(full_text, '(?i)square feet') THEN 'measured' END, CASE WHEN regexp_matches(price, '[0-9]') OR regexp_matches(title, '(?i)sale') THEN 'offer' END], lambda x: x IS NOT NULL) AS all_rules FROM broker_results""")
def H16_rule_sets(spark, d):
    """Rules in order of priority: a single pattern, patterns that must all match, patterns of which any may."""
    rules = RuleSet().add("large", 30, price="(?i)million|mio").add("measured", 20, price="[0-9]", full_text="(?i)square feet").add("offer", 10, any_of=True, price="[0-9]", title="(?i)sale")
    return table(spark, d, "broker_results", "result_id", "price", "title", "full_text").select("result_id", rules.first().alias("first_rule"), rules.every().alias("all_rules"))


_SENTENCES = r"regexp_extract_all(text, '[^.!?\s\x{00A0}][^.!?]*')"


@query(f"""SELECT doc_id, doc_type, round(CASE doc_type WHEN 'article' THEN 0.4 * (n_chars >= 500)::INT + 0.3 * contains(text, chr(10))::INT + 0.3 * (len({_SENTENCES}) >= 5)::INT
  WHEN 'listing' THEN 0.5 * regexp_matches(text, '[$€£]|[A-Z]{{3}} ?[0-9]|[0-9] ?[A-Z]{{3}}')::INT + 0.3 * regexp_matches(text, '[0-9]')::INT + 0.2 * (n_chars >= 100)::INT
  WHEN 'review' THEN 0.5 * regexp_matches(lower(text), 'better|worse|easier|recommend|prefer')::INT + 0.5 * (n_chars >= 200)::INT
  WHEN 'manual' THEN 0.5 * regexp_matches(text, '(?m)^(?:-|[0-9]+[.)])')::INT + 0.5 * (len({_SENTENCES}) >= 3)::INT ELSE 0.5 END, 6)::DOUBLE AS score FROM documents WHERE text IS NOT NULL""")
def Q5_typed_scores(spark, d):
    """Each type of document is scored by rules of its own; unknown types get 0.5."""
    t, n = F.col("text"), F.col("n_chars")
    on = lambda w, c: w * F.coalesce(c.cast("int"), F.lit(0))
    n_sentences = F.regexp_count(t, F.lit(r"[^.!?\s\x{00A0}][^.!?]*"))
    rules = {
        "article": on(0.4, n >= 500) + on(0.3, F.contains(t, F.lit("\n"))) + on(0.3, n_sentences >= 5),
        "listing": on(0.5, t.rlike("[$€£]|[A-Z]{3} ?[0-9]|[0-9] ?[A-Z]{3}")) + on(0.3, t.rlike("[0-9]")) + on(0.2, n >= 100),
        "review": on(0.5, F.lower(t).rlike("better|worse|easier|recommend|prefer")) + on(0.5, n >= 200),
        "manual": on(0.5, t.rlike(r"(?m)^(?:-|[0-9]+[.)])")) + on(0.5, n_sentences >= 3),
    }
    score = F.lit(0.5)
    for kind, rule in rules.items():
        score = F.when(F.col("doc_type") == kind, rule).otherwise(score)
    return table(spark, d, "documents", "doc_id", "doc_type", "text", "n_chars").filter("text is not null").select("doc_id", "doc_type", F.round(score, 6).alias("score"))


_TERMS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


@query(f"""SELECT hit_id, round(0.5 * coalesce(len(list_intersect(q, t)) / nullif(len(q), 0), 0) + 0.3 * coalesce(len(list_intersect(q, s)) / nullif(len(q), 0), 0) + 0.2 * coalesce(contains(lower(title), lower(query_text))::INT, 0), 6)::DOUBLE AS relevance
  FROM (SELECT hit_id, title, query_text, {_TERMS.format("query_text")} AS q, {_TERMS.format("title")} AS t, {_TERMS.format("snippet")} AS s FROM search_results)""")
def Q6_relevance(spark, d):
    """Share of the query's words in the title and in the snippet, and whether the title has the query as it stands."""
    q, t, s = (F.array_distinct(T.words(F.col(c))) for c in ("query_text", "title", "snippet"))
    share = lambda x: F.coalesce(F.when(F.size(q) > 0, F.size(F.array_intersect(q, x)) / F.size(q)), F.lit(0.0))
    whole = F.coalesce(F.contains(F.lower("title"), F.lower("query_text")).cast("int"), F.lit(0))
    return table(spark, d, "search_results", "hit_id", "query_text", "title", "snippet").select("hit_id", F.round(0.5 * F.when(F.col("title").isNull(), 0.0).otherwise(share(t)) + 0.3 * F.when(F.col("snippet").isNull(), 0.0).otherwise(share(s)) + 0.2 * whole, 6).alias("relevance"))


@query("""SELECT result_id, CASE WHEN price IS NULL OR trim(price) = '' THEN 0.0 WHEN regexp_matches(price, '[0-9]') AND regexp_matches(price, '[$€£¥₹]|[A-Za-z]{3}') THEN 0.9 WHEN regexp_matches(price, '[0-9]') THEN 0.7 ELSE 0.2 END::DOUBLE AS price_confidence,
  CASE WHEN detail_url IS NULL THEN 0.0 WHEN regexp_matches(detail_url, '^https?://[^/]+[.][^/]+/') THEN 0.95 ELSE 0.3 END::DOUBLE AS url_confidence FROM broker_results""")
def Q8_field_confidence(spark, d):
    p, u = F.col("price"), F.col("detail_url")
    price = F.when(F.coalesce(F.trim(p), F.lit("")) == "", 0.0).when(p.rlike("[0-9]") & p.rlike("[$€£¥₹]|[A-Za-z]{3}"), 0.9).when(p.rlike("[0-9]"), 0.7).otherwise(0.2)
    url = F.when(u.isNull(), 0.0).when(u.rlike("^https?://[^/]+[.][^/]+/"), 0.95).otherwise(0.3)
    return table(spark, d, "broker_results", "result_id", "price", "detail_url").select("result_id", price.alias("price_confidence"), url.alias("url_confidence"))


_CHECKS = {"title": "length(trim(title)) >= 5", "url": "regexp_matches(url, '^https?://')", "score": "relevance_score BETWEEN 0 AND 1", "ranking": "ranking >= 1"}


@query(f"""WITH c AS (SELECT domain, {", ".join(f"coalesce(({s})::INT, 0) AS c_{n}" for n, s in _CHECKS.items())}, ((title IS NOT NULL)::INT + (snippet IS NOT NULL)::INT + (relevance_score IS NOT NULL)::INT) / 3 AS filled,
  (relevance_score > 0.99 OR relevance_score < 0.01)::INT AS odd FROM search_results WHERE domain IS NOT NULL)
  SELECT domain, round(avg(({" + ".join(f"c_{n}" for n in _CHECKS)}) / 4), 6) AS compliance, round((avg(({" + ".join(f"c_{n}" for n in _CHECKS)}) / 4) + avg(filled) + greatest(0, 1 - coalesce(stddev_pop(filled), 0)) + 1 - avg(coalesce(odd, 0))) / 4, 6) AS assessment FROM c GROUP BY domain""")
def Q13_assessment(spark, d):
    """Compliance with a schema's checks, and its mean with completeness, consistency and the share of ordinary values."""
    h = table(spark, d, "search_results", "domain", "title", "url", "relevance_score", "ranking", "snippet").filter("domain is not null")
    checks = [F.length(F.trim("title")) >= 5, F.col("url").rlike("^https?://"), F.col("relevance_score").between(0, 1), F.col("ranking") >= 1]
    passed = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in checks), F.lit(0)) / 4
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("title", "snippet", "relevance_score")), F.lit(0)) / 3
    odd = F.coalesce(((F.col("relevance_score") > 0.99) | (F.col("relevance_score") < 0.01)).cast("int"), F.lit(0))
    one = h.select("domain", passed.alias("p"), filled.alias("f"), odd.alias("o")).groupBy("domain").agg(F.avg("p").alias("p"), F.avg("f").alias("f"), F.stddev_pop("f").alias("s"), F.avg("o").alias("o"))
    steady = F.greatest(F.lit(0.0), 1 - F.coalesce("s", F.lit(0.0)))
    return one.select("domain", F.round("p", 6).alias("compliance"), F.round((F.col("p") + F.col("f") + steady + 1 - F.col("o")) / 4, 6).alias("assessment"))


@query("""SELECT doc_type, arg_max(source, (q, source)) AS best, round(max(q), 6) AS score, count(*) AS compared FROM (SELECT doc_type, source, round(avg(least(n_chars / 1500, 1)), 6) AS q FROM documents WHERE source IS NOT NULL GROUP BY ALL) GROUP BY doc_type""")
def Q21_best_method(spark, d):
    """Of several methods (here sources) the one of best mean score per kind."""
    q = table(spark, d, "documents", "doc_type", "source", "n_chars").filter("source is not null").groupBy("doc_type", "source").agg(F.round(F.avg(F.least(F.col("n_chars") / 1500, F.lit(1.0))), 6).alias("q"))
    return q.groupBy("doc_type").agg(F.max_by("source", F.struct("q", "source")).alias("best"), F.round(F.max("q"), 6).alias("score"), F.count("*").alias("compared"))


@query(r"""SELECT result_id, list_transform(regexp_extract_all(full_text, '[0-9]+ square feet'), lambda x: regexp_extract(x, '[0-9]+', 0)::BIGINT) AS areas, regexp_extract_all(full_text, '\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b') AS months,
  list_distinct(regexp_extract_all(lower(full_text), '\b555-[0-9]{3,4}\b')) AS phones FROM broker_results WHERE full_text IS NOT NULL""")
def H15_extracted(spark, d):
    """Areas, months and telephone numbers that a text states."""
    t = F.col("full_text")
    areas = F.transform(F.regexp_extract_all(t, F.lit("([0-9]+) square feet")), lambda x: x.cast("bigint"))
    months = F.regexp_extract_all(t, F.lit(r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\b"))
    return table(spark, d, "broker_results", "result_id", "full_text").filter("full_text is not null").select("result_id", areas.alias("areas"), months.alias("months"), F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"\b(555-[0-9]{3,4})\b"))).alias("phones"))


@query(r"""SELECT result_id, CASE WHEN regexp_matches(detail_url, '^[a-z]+://') THEN trim(detail_url) WHEN trim(detail_url) <> '' THEN 'https://' || trim(detail_url) END AS url,
  nullif(regexp_replace(regexp_extract(full_text, '555-[0-9]{3,4}', 0), '[^0-9]', '', 'g'), '') AS phone, nullif(regexp_replace(regexp_replace(lower(trim(title)), '\s+', ' ', 'g'), '[!.]+$', ''), '') AS title FROM broker_results""")
def V8_typed_corrections(spark, d):
    """Addresses get a scheme, telephone numbers become digits, titles lose case, spare blanks and marks at their end."""
    u = F.col("detail_url")
    url = F.when(u.rlike("^[a-z]+://"), F.trim(u)).when(F.trim(u) != "", F.concat(F.lit("https://"), F.trim(u)))
    phone = F.nullif(F.regexp_replace(F.regexp_extract("full_text", "555-[0-9]{3,4}", 0), "[^0-9]", ""), F.lit(""))
    title = F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim("title")), r"\s+", " "), "[!.]+$", ""), F.lit(""))
    return table(spark, d, "broker_results", "result_id", "detail_url", "full_text", "title").select("result_id", url.alias("url"), phone.alias("phone"), title.alias("title"))


@query("""WITH t AS (SELECT DISTINCT category, seller, brand, round(price.amount, 2) AS amount FROM listing_items WHERE category IS NOT NULL)
  SELECT category, count(*) AS table_row_count, count(DISTINCT seller) AS n_tables, count(DISTINCT brand) AS brands FROM t GROUP BY category""")
def U11_tabular(spark, d):
    """Tables of one kind from several sources as one table without repeated rows, with its number of rows."""
    t = table(spark, d, "listing_items", "category", "seller", "brand", "price").filter("category is not null").select("category", "seller", "brand", F.round("price.amount", 2).alias("amount")).distinct()
    return t.groupBy("category").agg(F.count("*").alias("table_row_count"), F.count_distinct("seller").alias("n_tables"), F.count_distinct("brand").alias("brands"))


@query(r"""WITH w AS (SELECT doc_id, unnest(range(0, len(x), 200)) AS begin, x FROM (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')), ' ') AS x FROM documents WHERE trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) <> ''))
  SELECT doc_id, begin // 200 AS batch, array_to_string(x[greatest(begin - 20, 0) + 1:begin + 200], ' ') AS text FROM w""")
def T15_word_batches(spark, d):
    """Batches of 200 words, each with the 20 words before it as overlap."""
    flat = T.clean_whitespace(F.col("text"))
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", flat.alias("t")).filter("t <> ''").select("doc_id", F.split("t", " ").alias("x"))
    begun = docs.withColumn("begin", F.explode(F.sequence(F.lit(0), F.size("x") - 1, F.lit(200))))
    first = F.greatest(F.col("begin") - 20, F.lit(0))
    return begun.select("doc_id", (F.col("begin") / 200).cast("bigint").alias("batch"), F.array_join(F.slice("x", first + 1, F.col("begin") + 200 - first), " ").alias("text"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value < 20 AS bad, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE value IS NOT NULL),
  s AS (SELECT user_id, r, bad::INT AS fails, NULL::DOUBLE AS opened, true AS sent FROM e WHERE r = 1
        UNION ALL SELECT e.user_id, e.r, CASE WHEN s.opened IS NOT NULL AND e.sec < s.opened + 86400 THEN s.fails WHEN e.bad THEN s.fails + 1 ELSE 0 END,
          CASE WHEN s.opened IS NOT NULL AND e.sec < s.opened + 86400 THEN s.opened WHEN e.bad AND s.fails + 1 >= 2 THEN e.sec END, NOT (s.opened IS NOT NULL AND e.sec < s.opened + 86400) FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
  SELECT user_id, count(*) FILTER (WHERE sent) AS sent, count(*) FILTER (WHERE NOT sent) AS refused FROM s GROUP BY user_id""")
def R8_circuit_breaker(spark, d):
    """Two failures on end open a key's breaker for a day; the first call after that decides whether it closes."""
    from loomwork.streaming import circuit_breaker

    e = table(spark, d, "events").filter("value is not null").withColumn("bad", F.col("value") < 20)
    out = circuit_breaker(e, "user_id", "event_id", "ts", "bad", 2, 86400.0)
    return out.groupBy(F.col("key").cast("bigint").alias("user_id")).agg(F.count_if("sent").alias("sent"), F.count_if(~F.col("sent")).alias("refused"))
