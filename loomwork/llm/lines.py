"""Lines repeated across one site's documents: fixed-depth token trees of line templates.

A line is parsed into a template whose wildcard slots stand for runs of digits; letter case and white space do not
count. Its path in its site's tree has a fixed depth: site and length, leading token, trailing token (tokens are pieces of
six characters of what is left, since white space does not part them), and the leaf that holds the template itself. A task
builds the trees of its pages below one leaf and salt; the trees are merged from the top, and a node is opened only if
enough page entries lie below it: what lies in a closed node is dropped before the next level is looked at. In an opened
node equal leaves are merged by adding their page sets. A page counts once for each leaf, so that no node which covers
enough pages is ever closed. The lines are shuffled once by (path, leaf, salt); pages differ in salt, so no task holds a
hot site or a hot template.

``templates`` grows wider templates from the same kind of tree: its inner nodes are site, number of words and leading
words with wildcards for words that hold digits; only nodes that cover enough pages are opened, and in an opened node a
place where more than ``MAX_BRANCH`` different words stand becomes a wildcard slot.

Lines are split at '\\n' only and numbered from 1; blank lines are numbered but never reported. Null texts and pages
without a host give nothing. Repeated rows of one page count as one page.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
TOKEN, SALTS, MAX_BRANCH, TAIL = 6, 16, 8, 20


def site_of(url: Column) -> Column:
    """The host of an address in lower case without user, port and a leading 'www.'."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(bare != "", bare)


def template(line: Column) -> Column:
    """The fixed parts of a line, letter case, white space and the digits of its slots left out."""
    return F.lower(F.regexp_replace(line, r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\p{Nd}]+", ""))


def _lines(pages: DataFrame, page_id: str, url: str, text: str) -> DataFrame:
    """(page, site, line_no, line): every line that is not blank."""
    lines = pages.select(F.col(page_id).alias("page"), site_of(F.col(url)).alias("site"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line")).filter("site is not null")
    return lines.filter(~F.col("line").rlike(rf"^(?:{BLANK})?$")).select("page", "site", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def tree_lines(pages: DataFrame, page_id: str, url: str, text: str) -> DataFrame:
    """(path, leaf, salt, at): every line that is not blank with its place in its site's tree; ``at`` holds page and line number.

    A path packs 24 bits for site and length, 20 for the leading and 20 for the trailing token. Where two nodes have equal
    bits they are opened together; leaves are told apart by 96 bits more."""
    lines = _lines(pages, page_id, url, text).select("page", "site", "line_no", template(F.col("line")).alias("t"))
    parts = (24, F.xxhash64("site", F.length("t"))), (TAIL, F.xxhash64(F.substring("t", 1, TOKEN))), (TAIL, F.xxhash64(F.substring("t", -TOKEN, TOKEN)))
    path = F.lit(0).cast("bigint")
    for bits, part in parts:
        path = F.shiftleft(path, bits).bitwiseOR(part.bitwiseAND((1 << bits) - 1))
    leaf = F.struct(F.xxhash64("site", "t").alias("a"), F.hash("t").alias("b"))
    return lines.select(path.alias("path"), leaf.alias("leaf"), F.xxhash64("page").bitwiseAND(SALTS - 1).alias("salt"), F.array(F.col("page").cast("bigint"), F.col("line_no")).alias("at"))


def levels(trees: DataFrame, least_pages: int) -> list[DataFrame]:
    """Of trees (path, leaf, salt, n) what is left after each level: site and length, leading token, trailing token, leaf."""
    nodes = trees.withColumns({"length": F.shiftrightunsigned("path", 2 * TAIL), "lead": F.shiftrightunsigned("path", TAIL)})
    names = ["length", "lead", "path", "leaf"]
    # Sorted once for all levels; each node lies in one task.
    left, out = nodes.repartition("length").sortWithinPartitions(*names), []
    for depth in range(1, len(names) + 1):
        below = F.sum("n").over(Window.partitionBy(*names[:depth]))
        left = left.withColumn("below", below).filter(F.col("below") >= least_pages)
        out.append(left)
    return out


def standing_lines(pages: DataFrame, page_id: str = "page_id", url: str = "url", text: str = "main_content", least_pages: int = 6) -> DataFrame:
    """(page_id, line_no): every line whose leaf covers at least ``least_pages`` pages of its site."""
    # Page and line number travel as one array, and both uses ask for the same keys, so that they read the same shuffle.
    trees = tree_lines(pages, page_id, url, text).repartition("path", "leaf", "salt")
    own = trees.select("path", "leaf", "salt", F.col("at")[0].alias("page")).distinct().groupBy("path", "leaf", "salt").agg(F.count("*").alias("n"))
    hot = levels(own, least_pages)[-1].select("path", "leaf", "salt")
    # Not a semi join: that would be pushed below the shuffle, which then could not be shared.
    found = trees.join(hot, ["path", "leaf", "salt"])
    return found.select(F.col("at")[0].alias(page_id), F.col("at")[1].alias("line_no")).distinct()


def templates(pages: DataFrame, page_id: str = "page_id", url: str = "url", text: str = "main_content", least_pages: int = 6) -> DataFrame:
    """(site, template, n_pages): templates with wildcard slots ('*') that cover at least ``least_pages`` pages of a site."""
    flat = F.lower(F.trim(F.regexp_replace("line", BLANK, " ")))
    words = F.transform(F.split(flat, " "), lambda w: F.when(w.rlike(r"\p{Nd}"), F.lit("*")).otherwise(w))
    lines = _lines(pages, page_id, url, text).select("page", "site", words.alias("words"))
    lines = lines.select("*", F.xxhash64("site", F.size("words"), F.slice("words", 1, 2)).alias("node")).distinct()
    wide = lines.groupBy("node", "page").agg(F.lit(1).alias("one")).groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages).select("node")
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    opened = salted.join(wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["node", "salt"], "left_semi")
    branches = opened.select("node", F.posexplode("words").alias("place", "word")).distinct().groupBy("node", "place").agg(F.count("*").alias("n"))
    slots = branches.groupBy("node").agg(F.collect_list(F.when(F.col("n") > MAX_BRANCH, F.col("place"))).alias("slots"))
    joined = opened.join(slots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["node", "salt"])
    shape = F.array_join(F.transform("words", lambda w, i: F.when(F.array_contains("slots", i), F.lit("*")).otherwise(w)), " ")
    return joined.select("site", "page", shape.alias("template")).distinct().groupBy("site", "template").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= least_pages)


def without(pages: DataFrame, marked: DataFrame, page_id: str = "page_id", text: str = "main_content") -> DataFrame:
    """(page_id, n_removed, text): each page without its marked (page_id, line_no) lines; all pages come out."""
    gone = marked.groupBy(page_id).agg(F.collect_set("line_no").alias("_gone"))
    joined = pages.select(page_id, F.col(text).alias("_text")).join(gone, page_id, "left")
    kept = F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("_gone", (i + 1).cast("bigint")), F.lit(False)))
    return joined.select(page_id, F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"), F.array_join(kept, "\n").alias(text))
