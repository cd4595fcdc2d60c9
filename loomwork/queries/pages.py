"""HTML readings. The test tables hold no markup, so each query wraps known columns in markup and reads them back."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.html.columns import escape, read, selected
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


def mark(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(escape(p), F.lit("")) for p in parts])


ONE = r"trim(regexp_replace({0}, '[ \t\n\r\f\v\x{{00A0}}]+', ' ', 'g'))"


@query("SELECT page_id, " + ONE.format("coalesce(title, '')") + " AS text FROM page_data")
def H1_cleaned(spark, d):
    html = mark("<html><head><style>p {}</style><script>var a = '<p>x</p>';</script></head><body><nav><a href=/>Home</a></nav><p>", F.col("title"), "</p><footer>(c)</footer></body></html>")
    return table(spark, d, "page_data").select("page_id", read("cleaned", html).alias("text"))


@query("SELECT page_id, ['handler', 'iframe', 'script address'] AS threats FROM page_data")
def H2_threats(spark, d):
    html = mark("<p onclick='x()'>", F.col("title"), "</p><a href='JavaScript:y()'>z</a><iframe src=q></iframe>")
    return table(spark, d, "page_data").select("page_id", read("threats", html).alias("threats"))


@query("SELECT hit_id, " + ONE.format("coalesce(snippet, '')") + " AS body FROM search_results")
def H4_main_content(spark, d):
    html = mark("<body><div class=menu><a href=/a>", F.col("query_text"), "</a> <a href=/b>More</a></div><div id=c><article><p>", F.col("snippet"), "</p></article></div><aside>", F.col("title"), "</aside></body>")
    return table(spark, d, "search_results").select("hit_id", read("main_content", html).alias("body"))


@query("SELECT hit_id, [" + ONE.format("title") + "] AS found FROM search_results")
def H6_selected(spark, d):
    html = mark("<div class='row item'><a class=link href=/x>", F.col("title"), "</a><span>no</span></div><p><a class=link>outside</a></p>")
    return table(spark, d, "search_results").select("hit_id", selected(html, "div.item > a.link[href]").alias("found"))


@query("SELECT n_regionkey AS region, n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def H8_tables(spark, d):
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(mark("<tr><td>", F.col("n_nationkey").cast("string"), "<td>", F.col("n_name")))), "").alias("r"))
    html = F.concat(F.lit("<table><caption>Nations</caption><tr><th>key<th>name"), F.col("r"), F.lit("</table>"))
    found = rows.select("n_regionkey", F.explode(read("tables", html)).alias("t")).select("n_regionkey", F.explode("t.rows").alias("x"))
    return found.select(F.col("n_regionkey").alias("region"), F.col("x")[0].alias("key"), F.col("x")[1].alias("name"))


@query("SELECT item_id, unnest(features) AS feature FROM (SELECT DISTINCT item_id, features FROM listing_items) WHERE len(features) > 0")
def H9_lists(spark, d):
    items = table(spark, d, "listing_items", "item_id", "features").distinct().filter("size(features) > 0")
    html = F.concat(F.lit("<ul>"), F.array_join(F.transform("features", lambda x: mark("<li>", x)), ""), F.lit("</ul>"))
    return items.select("item_id", F.explode(read("lists", html)).alias("l")).select("item_id", F.explode("l.items").alias("feature"))


@query("SELECT hit_id, lower(split_part(url, '://', 1)) || substr(url, strpos(url, '://')) AS url, " + ONE.format("title") + " AS text, false AS internal FROM search_results UNION ALL SELECT hit_id, 'https://own.example/about', 'About', true FROM search_results")
def H10_links(spark, d):
    html = mark('<a href="', F.col("url"), '">', F.col("title"), "</a><a href='about'>About</a><a href='#top'>Top</a>")
    df = table(spark, d, "search_results").filter("url is not null").select("hit_id", F.explode(read("links", html, F.lit("https://own.example/index"))).alias("l"))
    return df.select("hit_id", "l.url", "l.text", "l.internal")


@query("SELECT page_id, " + ONE.format("title") + " AS title, url AS canonical, json_extract_string(structured_data, '$.type') AS kind FROM page_data WHERE title IS NOT NULL AND trim(title) <> ''")
def H11_metadata(spark, d):
    df = table(spark, d, "page_data").filter("title is not null and trim(title) <> ''")
    html = F.concat(mark("<head><title>", F.col("title"), '</title><link rel=canonical href="', F.col("url"), '"><script type="application/ld+json">'), F.coalesce("structured_data", F.lit("{}")), F.lit("</script></head>"))
    m = df.select("page_id", read("metadata", html).alias("m"))
    return m.select("page_id", F.col("m")["title"].alias("title"), F.col("m")["canonical"].alias("canonical"), F.col("m")["ld:type"].alias("kind"))


@query("SELECT c_custkey, 'li.hit' AS shape, 3 + c_custkey % 3 AS n FROM customer")
def H18_repeated(spark, d):
    html = F.concat(F.lit("<div><ol>"), F.array_join(F.array_repeat(F.lit("<li class=hit><b>x</b></li>"), (F.col("c_custkey") % 3 + 3).cast("int")), ""), F.lit("</ol></div>"))
    df = table(spark, d, "customer").select("c_custkey", F.explode(read("repeated_items", html)).alias("r"))
    return df.select("c_custkey", "r.shape", F.col("r.n").cast("bigint").alias("n"))


@query("SELECT p_partkey, 3 AS depth, p_size + 2 AS n_elements, p_size AS n_links FROM part")
def H19_structure(spark, d):
    html = F.concat(F.lit("<body><div>"), F.array_join(F.array_repeat(F.lit("<a href=/>x</a>"), F.col("p_size")), ""), F.lit("</div></body>"))
    s = table(spark, d, "part").select("p_partkey", read("structure", html).alias("s"))
    return s.select("p_partkey", "s.depth", "s.n_elements", "s.n_links")


@query("SELECT p_partkey, 'https://h.example/list?page=' || (p_size + 1) AS next, p_size + 5 AS last FROM part")
def H20_pagination(spark, d):
    n = F.col("p_size")
    html = F.concat(F.lit("<a href='?page=1'>1</a><a href='?page=9'>"), (n + 5).cast("string"), F.lit("</a><a rel=next href='?page="), (n + 1).cast("string"), F.lit("'>Next</a>"))
    p = table(spark, d, "part").select("p_partkey", read("pagination", html, F.lit("https://h.example/list")).alias("p"))
    return p.select("p_partkey", "p.next", "p.last")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 0.82 ELSE 0.02 END::DOUBLE AS score FROM part")
def H22_needs_scripts(spark, d):
    html = F.when(F.col("p_size") > 25, F.lit("<div id=root></div><script src=a></script>")).otherwise(F.concat(F.lit("<script></script><p>"), F.repeat(F.lit("text "), 60)))
    return table(spark, d, "part").select("p_partkey", read("needs_scripts", html).alias("score"))
