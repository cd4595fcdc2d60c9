"""Duplicates hidden by formatting: progressive partition refinement.

Rows start in one class and are split by ever costlier keys; a row leaves as soon as its class has one member:

1. cheap invariants of the raw texts: which fields are null and a histogram of some letters and digits over all texts
   and addresses. No text is normalised for this,
2. for the rows of classes with several members the normalised content itself, as a 256-bit digest.

Round 1 shuffles (key, count) pairs that are aggregated before the shuffle. The keys of classes with several members
are joined back with salt, so that a class holding a third of all rows is spread over many tasks; only there, past the
join, texts are normalised. The last grouping works on (id, keys) rows, and no class is collected anywhere.

Two rows are copies when all fields agree after letter case, white space and punctuation are left out. In an address
the parameters after the first '?' may stand in any order. An object field (JSON) is compared by its entries. Null
agrees only with null; a blank or purely punctuated text agrees with any other such text. Rows with equal ids count
once; rows without an id are ignored.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Characters whose number no formatting changes; 's' would not do, since 'ß' is folded to it.
LETTERS = "eanr10"


def fold(c: Column) -> Column:
    """The letters and digits of a text in one letter case ('ß' becomes 'ss')."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}\p{M}]+", "")


def fold_address(c: Column) -> Column:
    """The folded part before the first '?' and the folded parameters after it in sorted order."""
    cut = F.instr(c, "?")
    path = F.when(cut == 0, c).otherwise(F.substring(c, F.lit(1), cut - 1))
    query = F.when(cut == 0, F.lit("")).otherwise(F.substring(c, cut + 1, F.length(c)))
    params = F.array_sort(F.filter(F.transform(F.split(query, "&"), fold), lambda x: x != ""))
    return F.concat_ws("&", fold(path), params)


def fold_object(c: Column) -> Column:
    """The entries of a flat JSON object in the order of their keys; a text that is no object is folded as a text."""
    entries = F.map_entries(F.from_json(c, "map<string,string>"))
    listed = F.concat_ws("&", F.array_sort(F.transform(entries, lambda e: F.concat_ws("=", fold(e["key"]), F.coalesce(fold(e["value"]), F.lit("null"))))))
    return F.when(entries.isNotNull(), F.concat(F.lit("&"), listed)).otherwise(fold(c))


def refine(df: DataFrame, row_id: str, texts: list[str], addresses: list[str] = (), objects: list[str] = ()) -> DataFrame:
    """(row_id, first_id, n_copies): each row of a class with several members, the least id of the class and its size."""
    rows = df.select(F.col(row_id).cast("bigint").alias("_id"), *[F.col(x).cast("string").alias(f"_t{i}") for i, x in enumerate([*texts, *addresses, *objects])]).filter("_id is not null")
    raw = [F.col(f"_t{i}") for i in range(len(texts) + len(addresses) + len(objects))]
    plain = [F.lower(c) for c in raw[: len(texts) + len(addresses)]]
    # An object's raw text may be escaped in several ways, so only its being null counts here.
    whole = F.col("_whole")
    histogram = [F.length(whole) - F.length(F.replace(whole, F.lit(x))) for x in LETTERS]
    cheap = rows.withColumn("_whole", F.concat_ws("", *plain)).withColumn("_k1", F.xxhash64(*[c.isNull() for c in raw], *histogram)).drop("_whole")
    several = cheap.groupBy("_k1").agg(F.count("*").alias("_n")).filter("_n > 1").select("_k1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = cheap.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(several, ["_k1", "_salt"], "left_semi")
    folds = [*[fold] * len(texts), *[fold_address] * len(addresses), *[fold_object] * len(objects)]
    content = F.concat_ws("\u0001", *[F.coalesce(f(c), F.lit("\u0002")) for f, c in zip(folds, raw, strict=True)])
    keyed = kept.select("_id", "_k1", F.unhex(F.sha2(content, 256)).alias("_k2")).distinct()
    groups = keyed.groupBy("_k1", "_k2").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = keyed.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    return rows.join(spread, ["_k1", "_k2", "_salt"]).select(F.col("_id").alias("row_id"), F.col("_first").alias("first_id"), F.col("_n").alias("n_copies"))


FIELDS = {
    "search_results": ("hit_id", ["title", "snippet"], ["url"], ["metadata"]),
    "broker_results": ("result_id", ["title", "price", "full_text"], ["detail_url"], []),
}


def copies(tables: dict[str, DataFrame]) -> DataFrame:
    """(src_table, first_id, copy_id) over the tables of FIELDS."""
    parts = []
    for name, df in tables.items():
        row_id, texts, addresses, objects = FIELDS[name]
        found = refine(df.select(row_id, *texts, *addresses, *objects), row_id, texts, addresses, objects)
        parts.append(found.filter("row_id <> first_id").select(F.lit(name).alias("src_table"), "first_id", F.col("row_id").alias("copy_id")))
    return reduce(DataFrame.unionByName, parts)


def counted(df: DataFrame, name: str) -> DataFrame:
    """One row per distinct record: (id of the least copy, n_copies)."""
    row_id, texts, addresses, objects = FIELDS[name]
    found = refine(df.select(row_id, *texts, *addresses, *objects), row_id, texts, addresses, objects)
    rest = df.select(F.col(row_id).cast("bigint").alias("row_id")).filter("row_id is not null").distinct().join(found, "row_id", "left_anti")
    firsts = found.filter("row_id = first_id").select("row_id", "n_copies")
    return firsts.unionByName(rest.select("row_id", F.lit(1).cast("bigint").alias("n_copies"))).withColumnRenamed("row_id", row_id)


def collapsed(tables: dict[str, DataFrame]) -> DataFrame:
    """(src_table, rec_id, n_copies): one row per distinct record of every table."""
    return reduce(DataFrame.unionByName, [counted(df, name).select(F.lit(name).alias("src_table"), F.col(FIELDS[name][0]).alias("rec_id"), "n_copies") for name, df in tables.items()])


def records(tables: dict[str, DataFrame]) -> DataFrame:
    """(src_table, rec_id, n_copies, every other column): the record of least id of each group of copies, over all tables."""
    parts = []
    for name, df in tables.items():
        row_id, texts, addresses, objects = FIELDS[name]
        keyed = df.withColumn(row_id, F.col(row_id).cast("bigint")).filter(F.col(row_id).isNotNull())
        found = refine(df.select(row_id, *texts, *addresses, *objects), row_id, texts, addresses, objects)
        # Only rows with copies are on the right side; a row that is not there is a record of its own.
        whole = keyed.join(found.select(F.col("row_id").alias(row_id), F.col("first_id").alias("_least"), "n_copies"), row_id, "left").filter(F.col("_least").isNull() | (F.col("_least") == F.col(row_id)))
        whole = whole.withColumn("n_copies", F.coalesce("n_copies", F.lit(1).cast("bigint"))).dropDuplicates([row_id])
        parts.append(whole.select(F.lit(name).alias("src_table"), F.col(row_id).alias("rec_id"), "n_copies", *[c for c in df.columns if c != row_id]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
