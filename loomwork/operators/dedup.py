"""Duplicates with a defined survivor, merges field by field, identity keys. Order always comes from a column, never from the input."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; a row with a null in its key is nobody's duplicate and stays."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.withColumns({n: (F.col(k) if isinstance(k, str) else k) for n, k in zip(names, keys, strict=True)})
    missing = F.lit(False)
    for n in names:
        missing = missing | F.col(n).isNull()
    keyed = keyed.withColumn("_alone", F.when(missing, F.monotonically_increasing_id()))
    names = [*names, "_alone"]
    # min over a struct aggregates before the shuffle, unlike a window.
    ranked = [o.alias(f"o{i}") for i, o in enumerate(order)]
    best = keyed.groupBy(*names).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*ranked)).alias("_row"))
    return best.select("_row.*")


def merge_fill(df: DataFrame, key: list[str], order: Column, fields: list[str]) -> DataFrame:
    """One row per key; each field is the first value in ``order`` that is neither null nor empty."""
    def first(f: str) -> Column:
        good = F.when(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != ""), F.col(f))
        return F.min_by(good, F.when(good.isNotNull(), order)).alias(f)

    return df.groupBy(*key).agg(*[first(f) for f in fields], F.count("*").alias("merge_count"))


def survivorship(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per key; each field is the value of greatest ``rules[field]``, nulls never win over values."""
    return df.groupBy(*key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(r.alias("r"), F.col(f).cast("string").alias("v")))).alias(f) for f, r in rules.items()], F.count("*").alias("merge_count"))


def identity_key(*candidates: tuple[str, Column]) -> Column:
    """The first candidate that is neither null nor blank, named by its kind."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{kind}:"), F.lower(F.trim(c.cast("string"))))) for kind, c in candidates])


def in_batches(df: DataFrame, key: str, batch: str, least: int) -> DataFrame:
    """Keys that occur in at least ``least`` different batches."""
    return df.filter(F.col(key).isNotNull()).select(key, batch).distinct().groupBy(key).agg(F.count("*").alias("n_batches")).filter(F.col("n_batches") >= least)


def concat_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``seen``; rows without a key stay."""
    return df.join(seen.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Old rows overlaid by new ones of the same key; a null in a new row keeps the old value."""
    o, n = (x.select(F.col(key), *[F.col(f).alias(f"{p}{f}") for f in fields]) for x, p in ((old, "_o"), (new, "_n")))
    return o.join(n, key, "full").select(key, *[F.coalesce(f"_n{f}", f"_o{f}").alias(f) for f in fields])


def per_key_rank(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, numbered in ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= k)
