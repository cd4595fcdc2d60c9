"""Run statistics: grouped aggregates, time buckets, trends, anomalies, trailing windows, entropy."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def rates(df: DataFrame, by: list[str], ok: Column, value: Column) -> DataFrame:
    """total, ok, failed, success_rate and avg/min/max of a value per group."""
    out = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return out.withColumn("failed", F.col("total") - F.col("ok")).withColumn("success_rate", F.col("ok") / F.col("total"))


def value_at(df: DataFrame, by: str, value: str, rank: Callable[[Column], Column], ranges: int = 4096) -> DataFrame:
    """(by, at, low, high, n): the value of rank ``rank(n)`` (from 1) among the n values of each group, nulls left out.

    Values are counted in equal ranges between the group's ends; only the values of the range that holds the rank are
    put in order, equal ones counted once, so that no group is sorted in one task.
    """
    v = df.filter(F.col(value).isNotNull()).select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v"), F.col(value).alias("_raw"))
    ends = v.groupBy("_g").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.min("_raw").alias("low"), F.max("_raw").alias("high"), F.count("*").alias("n"))
    spread = ends.select(F.col("_g").alias("_h"), "_low", "_high", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salted = v.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    width = (F.col("_high") - F.col("_low")) / ranges
    place = F.when(width > 0, F.least(F.lit(ranges - 1), F.floor((F.col("_v") - F.col("_low")) / width))).otherwise(0)
    ranged = salted.join(spread, (F.col("_salt") == F.col("_s")) & F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_raw", place.cast("int").alias("_r"))
    counted = ranged.groupBy("_g", "_r", "_raw").agg(F.count("*").alias("_k"))
    sums = counted.groupBy("_g", "_r").agg(F.sum("_k").alias("_k"))
    before = sums.withColumn("_upto", F.sum("_k").over(Window.partitionBy("_g").orderBy("_r")))
    total = ends.select(F.col("_g").alias("_h"), "low", "high", "n")
    wanted = before.join(total, F.col("_g").eqNullSafe(F.col("_h"))).select("_h", F.col("_r").alias("_q"), (F.col("_upto") - F.col("_k")).alias("_before"), "_upto", rank(F.col("n")).alias("_at"), "low", "high", "n")
    wanted = wanted.filter("_at > _before and _at <= _upto")
    near = counted.join(wanted, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_r") == F.col("_q")))
    upto = F.sum("_k").over(Window.partitionBy("_g").orderBy("_raw")) + F.col("_before")
    return near.withColumn("_upto2", upto).filter(F.col("_upto2") >= F.col("_at")).groupBy(F.col("_g").alias(by), "low", "high", "n").agg(F.min("_raw").alias("at")).select(by, "at", "low", "high", "n")


def buckets(df: DataFrame, ts: str, width: str, by: list[str], aggs: list[Column]) -> DataFrame:
    """Tumbling windows; the same expression runs on a stream."""
    return df.groupBy(F.window(ts, width), *by).agg(*aggs).withColumn("bucket", F.col("window.start")).drop("window")


def zscore(df: DataFrame, by: str, order: list[str], value: str, least: int = 4, limit: float = 2.0) -> DataFrame:
    """Each value against all before it in its group: z and whether it is an anomaly; fewer than ``least`` give null."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n, mean, sd = F.count(value).over(w), F.avg(value).over(w), F.stddev_pop(value).over(w)
    z = F.when((n >= least) & (sd > 0), (F.col(value) - mean) / sd)
    return df.withColumn("z", z).withColumn("anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))


def trailing_count(df: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """How many rows of the group lie within the trailing ``seconds``, the row itself included."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count("*").over(w))


def entropy(df: DataFrame, value: str) -> DataFrame:
    """Shannon entropy (bits), distinct and total number of the values of a column; nulls left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("n_distinct"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(F.lit(value).alias("field"), "total", "n_distinct", (F.log2("total") - F.col("s") / F.col("total")).alias("entropy"))


def presence(df: DataFrame, fields: list[str]) -> DataFrame:
    """present, missing and rate per field, in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count(F.when(F.trim(F.col(f).cast("string")) != "", 1)).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), (F.col("n") - F.col(f)).alias("missing"), F.when(F.col("n") > 0, F.col(f) / F.col("n")).alias("rate")) for f in fields])).alias("x")).select("x.*")


def top_words(df: DataFrame, by: str, tokens: Column, k: int) -> DataFrame:
    """The k most frequent words per group, ties in alphabetical order; counted before the shuffle, ranked on counts only."""
    counts = df.select(by, F.explode(tokens).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= k)
