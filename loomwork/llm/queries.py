"""The subpackage's queries (spark, sf_dir) -> DataFrame and, where SQL can say the same, their SQL."""

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import boilerplate, leakage, lines, mixing, products, refine, residue, spans
from loomwork.plans.lineage import cut
from loomwork.sources import table


def _page_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        table(spark, sf_dir, "scraped_content", "content_id", "content", "url"),
        table(spark, sf_dir, "broker_results", "result_id", "full_text", "detail_url"),
        table(spark, sf_dir, "page_data", "page_id", "title", "url"),
    )


def _texts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name, rec, text, "title") for name, (rec, text) in boilerplate.SOURCES.items()}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.found(_texts(spark, sf_dir))


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_bodies(_texts(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.found(table(spark, sf_dir, "listing_items", "item_id", "title", "brand", "features"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.groups(table(spark, sf_dir, "listing_items", "item_id", "title", "brand", "features"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found(*_page_tables(spark, sf_dir))


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(residue.sources(*_page_tables(spark, sf_dir)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.copies({n: table(spark, sf_dir, n) for n in refine.FIELDS})


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.collapsed({n: table(spark, sf_dir, n) for n in refine.FIELDS})


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.records({n: table(spark, sf_dir, n) for n in refine.FIELDS})


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.standing_lines(table(spark, sf_dir, "page_data", "page_id", "url", "main_content"))


def p7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "page_data", "page_id", "url", "main_content")
    return lines.without(pages, lines.standing_lines(pages))


def p7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.templates(table(spark, sf_dir, "page_data", "page_id", "url", "main_content"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.found(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.found(table(spark, sf_dir, "documents", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p9_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(mixing.token_counts(table(spark, sf_dir, "documents", "doc_id", "source", "text")))
    return mixing.selected(counts, table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.found(table(spark, sf_dir, "documents", "doc_id", "text"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.Spans(table(spark, sf_dir, "documents", "doc_id", "text")).coverage()


def p10_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.Spans(table(spark, sf_dir, "documents", "doc_id", "text")).factors()


QUERIES = {f.__name__: f for f in (p3_found, p3_pages, p4_found, p4_groups, p5_found, p5_reasons, p6_found, p6_collapsed, p6_records, p7_found, p7_pages, p7_templates, p8_found, p8_leaks, p9_found, p9_shares, p9_selected, p10_found, p10_shared, p10_factors)}

_FOLD = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"


def _fold(c: str) -> str:
    return _FOLD.format(c)


def _address(c: str) -> str:
    params = f"list_sort(list_filter(list_transform(string_split(CASE WHEN strpos({c}, '?') = 0 THEN '' ELSE substr({c}, strpos({c}, '?') + 1) END, '&'), lambda x: {_fold('x')}), lambda x: x <> ''))"
    return f"{_fold(f'string_split({c}, chr(63))[1]')} || '&' || array_to_string({params}, '&')"


_P6_KEYS = f"""
  SELECT 'search_results' AS src_table, hit_id AS id, {_fold('title')} AS a, {_fold('snippet')} AS b, {_address('url')} AS c,
         array_to_string(list_sort(list_transform(json_keys(metadata), lambda k: {_fold('k')} || '=' || coalesce({_fold('json_extract_string(metadata, k)')}, 'null'))), '&') AS d
  FROM search_results
  UNION ALL
  SELECT 'broker_results', result_id, {_fold('title')}, {_fold('price')}, {_fold('full_text')}, {_address('detail_url')} FROM broker_results"""

_P7_LINES = """
  WITH pages AS (
    SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') AS site, string_split(main_content, chr(10)) AS x
    FROM page_data WHERE main_content IS NOT NULL),
  lines AS (SELECT page_id, site, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM pages),
  keyed AS (SELECT page_id, site, line_no, lower(regexp_replace(line, '[\\s\\p{Z}\\p{Nd}]+', '', 'g')) AS k FROM lines WHERE NOT regexp_full_match(line, '[\\s\\p{Z}]*')),
  hot AS (SELECT site, k FROM keyed GROUP BY site, k HAVING count(DISTINCT page_id) >= 6),
  found AS (SELECT DISTINCT page_id, line_no FROM keyed JOIN hot USING (site, k))"""

_P8_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}\\p{M}]+'), lambda w: w <> '')"

_P10 = """
  WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
  reps AS (SELECT min(doc_id) AS rep, text, count(*) AS n_copies FROM texts GROUP BY text),
  members AS (SELECT doc_id, rep, n_copies, length(text) AS n FROM texts JOIN reps USING (text)),
  places AS (SELECT rep, unnest(range(length(text) - 299)) AS s, text FROM reps),
  grams AS (SELECT rep, s, hash(substr(text, s + 1, 300)) AS h FROM places),
  several AS (SELECT h, min((rep, s)) AS low, max((rep, s)) AS high FROM grams GROUP BY h HAVING min(rep) <> max(rep)),
  shared AS (SELECT rep, s, h, CASE WHEN rep = low[1] THEN high ELSE low END AS w FROM grams JOIN several USING (h)),
  islands AS (SELECT rep, s, w[1] AS ref, s - w[2] AS shift, s - row_number() OVER (PARTITION BY rep, w[1], s - w[2] ORDER BY s) AS island FROM shared),
  factors AS (SELECT rep, min(s) AS start, max(s) - min(s) + 300 AS size, ref, min(s) - shift AS ref_start FROM islands GROUP BY rep, ref, shift, island)"""

ORACLES = {
    # Sizes in characters: no source lies so close to its share that the unit matters, from scale 0.01 on.
    "p9_found": """WITH sizes AS (SELECT source, sum(length(text)) AS n FROM documents GROUP BY source)
  SELECT t.source FROM mix_targets t LEFT JOIN sizes s USING (source) WHERE t.max_repeats * coalesce(s.n, 0) < t.target_share * (SELECT sum(n) FROM sizes)""",
    "p10_found": f"""{_P10}, links AS (SELECT DISTINCT a.rep AS x, b.rep AS y FROM (SELECT DISTINCT rep, h FROM shared) a JOIN (SELECT DISTINCT rep, h FROM shared) b USING (h))
  SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT x, y FROM links UNION SELECT rep, rep FROM members) JOIN members a ON a.rep = x JOIN members b ON b.rep = y WHERE a.doc_id < b.doc_id""",
    "p10_factors": f"{_P10} SELECT * FROM factors",
    "p10_shared": f"""{_P10}, gaps AS (SELECT rep, s, lag(s) OVER (PARTITION BY rep ORDER BY s) AS prev FROM shared),
  chars AS (SELECT rep, sum(CASE WHEN prev IS NULL OR s - prev > 300 THEN 300 ELSE s - prev END)::BIGINT AS chars FROM gaps GROUP BY rep),
  sums AS (SELECT rep, count(*) AS n_factors, count(DISTINCT ref) AS n_refs FROM factors GROUP BY rep)
  SELECT doc_id, rep AS class_id, n_copies, coalesce(n_factors, 0) AS n_factors, coalesce(n_refs, 0) AS n_refs, CASE WHEN n_copies > 1 THEN n ELSE chars END AS shared_chars, n AS n_chars
  FROM members LEFT JOIN sums USING (rep) LEFT JOIN chars USING (rep) WHERE n_copies > 1 OR chars > 0""",
    "p6_found": f"WITH keyed AS ({_P6_KEYS}), firsts AS (SELECT *, min(id) OVER (PARTITION BY src_table, a, b, c, d) AS first_id FROM keyed) SELECT DISTINCT src_table, first_id, id AS copy_id FROM firsts WHERE id <> first_id",
    "p6_collapsed": f"WITH keyed AS ({_P6_KEYS}) SELECT src_table, min(id) AS rec_id, count(*) AS n_copies FROM keyed GROUP BY src_table, a, b, c, d",
    "p7_found": f"{_P7_LINES} SELECT page_id, line_no FROM found",
    "p7_pages": f"""{_P7_LINES}
  SELECT p.page_id, count(f.line_no)::INT AS n_removed,
         CASE WHEN any_value(p.main_content) IS NULL THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE f.line_no IS NULL AND l.line_no IS NOT NULL), '') END AS main_content
  FROM page_data p LEFT JOIN lines l ON l.page_id = p.page_id LEFT JOIN found f ON f.page_id = l.page_id AND f.line_no = l.line_no GROUP BY p.page_id""",
    "p7_templates": """
  WITH pages AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', ''), '') AS site, unnest(string_split(main_content, chr(10))) AS line FROM page_data),
  worded AS (SELECT DISTINCT page_id, site, list_transform(string_split(lower(trim(regexp_replace(line, '[\\s\\p{Z}]+', ' ', 'g'))), ' '), lambda w: CASE WHEN regexp_matches(w, '\\p{Nd}') THEN '*' ELSE w END) AS words
    FROM pages WHERE site IS NOT NULL AND NOT regexp_full_match(line, '[\\s\\p{Z}]*')),
  opened AS (SELECT *, dense_rank() OVER (ORDER BY site, len(words), words[1:2]) AS node FROM worded),
  wide AS (SELECT node FROM opened GROUP BY node HAVING count(DISTINCT page_id) >= 6),
  places AS (SELECT node, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM opened WHERE node IN (FROM wide)),
  slots AS (SELECT node, list(place) AS slots FROM (SELECT node, place FROM places GROUP BY node, place HAVING count(DISTINCT word) > 8) GROUP BY node),
  shaped AS (SELECT DISTINCT site, page_id, array_to_string(list_transform(words, lambda w, i: CASE WHEN list_contains(slots, i) THEN '*' ELSE w END), ' ') AS template FROM opened LEFT JOIN slots USING (node) WHERE node IN (FROM wide))
  SELECT site, template, count(*) AS n_pages FROM shaped GROUP BY ALL HAVING count(*) >= 6""",
    "p8_found": f"""WITH i AS (SELECT item_id, {_P8_WORDS} AS w FROM eval_items), d AS (SELECT doc_id, {_P8_WORDS} AS w FROM documents WHERE text IS NOT NULL),
  iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM i WHERE len(w) > 12),
  dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM d WHERE len(w) > 12)
  SELECT DISTINCT item_id, doc_id FROM iw JOIN dw USING (g)""",
}
