"""Projections: chosen and renamed fields, named casts, computed fields, changes against the original."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import values

CASTS: dict[str, Callable[[Column], Column]] = {
    "uppercase": F.upper,
    "lowercase": F.lower,
    "capitalize": lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1_000_000_000))),
    "strip": F.trim,
    "to_float": lambda c: values.to_number(c.cast("string")),
    "to_int": lambda c: values.to_number(c.cast("string")).cast("bigint"),
    "to_string": lambda c: c.cast("string"),
    "to_boolean": lambda c: values.to_boolean(c.cast("string")),
    "iso_date": lambda c: F.date_format(values.to_date(c.cast("string")), "yyyy-MM-dd"),
}


def transform(df: DataFrame, include: list[str] | None = None, exclude: list[str] = (), rename: dict[str, str] | None = None, casts: dict[str, str] | None = None, add: dict[str, Column] | None = None, keep_original: bool = False) -> DataFrame:
    """In this order: keep originals, casts, added fields, include or exclude, rename."""
    if keep_original:
        df = df.withColumns({f"_original_{c}": F.col(c) for c in (casts or {})})
    df = df.withColumns({c: CASTS[k](F.col(c)) for c, k in (casts or {}).items()})
    df = df.withColumns(add or {})
    if include is not None:
        df = df.select(*include)
    return df.drop(*exclude).withColumnsRenamed(rename or {})


def changes(fields: list[str]) -> Column:
    """Names of the fields that differ from their '_original_' copy, nulls compared as values."""
    return F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_original_{f}")), F.lit(f)) for f in fields]))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct columns lifted to the top, arrays and maps written as JSON."""
    from pyspark.sql import types as T

    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        df = df.select(*[x for f in df.schema.fields for x in ([F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{sep}{g.name}") for g in f.dataType.fields] if isinstance(f.dataType, T.StructType) else [F.col(f"`{f.name}`")])])
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields])
