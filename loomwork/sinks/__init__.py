"""Writers: JSON lines, CSV, XML, text by template, partitioned parquet, upsert by key, retention."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.dedup import upsert
from loomwork.operators.project import flatten


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Each row as JSON with its keys in order and nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns or df.columns)]), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str, sort_keys: bool = False, mode: str = "error") -> None:
    if sort_keys:
        df.select(canonical_json(df).alias("value")).write.mode(mode).text(path)
    else:
        df.write.mode(mode).json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Structs lifted to columns, arrays and maps as JSON, nulls as empty fields."""
    flatten(df).write.mode(mode).csv(path, header=True, escape='"', quoteAll=True, emptyValue="", nullValue="")


def write_xml(df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "rows", mode: str = "error") -> None:
    df.write.mode(mode).xml(path, rowTag=row_tag, rootTag=root_tag)


def write_text(df: DataFrame, path: str, template: str, columns: list[str], mode: str = "error") -> None:
    """One line per row by a printf template over ``columns``; nulls as empty texts."""
    df.select(F.format_string(template, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")).write.mode(mode).text(path)


def write_markdown(df: DataFrame, path: str, mode: str = "error") -> None:
    flat = flatten(df)
    cells = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in flat.columns]
    flat.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), files_per_partition: int = 1, mode: str = "error") -> None:
    """Parquet; rows of one partition value are spread over ``files_per_partition`` tasks, so a hot value is no single task."""
    if partition_by:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]), F.lit(files_per_partition)))
        df = salted.repartition(*partition_by, "_salt").drop("_salt")
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_upsert(new: DataFrame, path: str, key: str, out: str) -> None:
    """The table at ``path`` overlaid by ``new``, written to ``out``; readers of ``path`` are never disturbed."""
    old = new.sparkSession.read.parquet(path)
    upsert(old, new, key, [c for c in old.columns if c != key]).write.mode("error").parquet(out)


def retained(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; rows without a time stay."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= F.expr(f"timestamp'{as_of}' - interval {int(days)} days")))
