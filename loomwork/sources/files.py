"""Files in many formats as DataFrames. The format is told by the ending; what cannot be parsed is kept in ``_corrupt``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv", ".tsv": "tsv", ".xml": "xml", ".parquet": "parquet", ".orc": "orc", ".txt": "text", ".md": "text", ".log": "text", ".html": "html", ".htm": "html", ".yaml": "text", ".yml": "text"}


def format_of(path: str) -> str:
    """By the last ending, compression left aside; 'binary' when unknown."""
    name = path.lower().rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".bz2").removesuffix(".zst")
    return FORMATS.get("." + name.rsplit(".", 1)[-1] if "." in name else "", "binary")


def read(spark: SparkSession, paths: str | list[str], fmt: str | None = None, schema: T.StructType | str | None = None, row_tag: str = "row", encoding: str = "UTF-8", header: bool = True, quote: str = '"', sep: str = ",") -> DataFrame:
    """One DataFrame of all ``paths`` (files, folders, globs). CSV fields are strings; a schema is never guessed from CSV."""
    one = paths if isinstance(paths, str) else paths[0]
    fmt = fmt or format_of(one)
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt in ("json", "jsonl"):
        return reader.json(paths, multiLine=fmt == "json", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", encoding=encoding)
    if fmt in ("csv", "tsv"):
        return reader.csv(paths, sep="\t" if fmt == "tsv" else sep, quote=quote, header=header, inferSchema=False, multiLine=True, escape='"', encoding=encoding)
    if fmt == "xml":
        return reader.xml(paths if isinstance(paths, str) else ",".join(paths), rowTag=row_tag)
    if fmt == "text":
        return spark.read.text(paths)
    if fmt == "html":
        return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    if fmt in ("parquet", "orc"):
        return reader.load(paths, format=fmt)
    return spark.read.format("binaryFile").load(paths)


def listing(spark: SparkSession, folder: str, recursive: bool = False, pattern: str = "*") -> DataFrame:
    """(path, name, size, modified, format) of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    ending = F.concat(F.lit("."), F.element_at(F.split(F.regexp_replace(name, r"\.(gz|bz2|zst)$", ""), r"\."), -1))
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.coalesce(F.try_element_at(known, ending), F.lit("binary")).alias("format"))


def sitemap(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(loc, lastmod) of captured sitemap files."""
    schema = "loc string, lastmod string"
    return spark.read.schema(schema).xml(paths if isinstance(paths, str) else ",".join(paths), rowTag="url")


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns have the given values; the equality reaches the scan."""
    for name, value in keys.items():
        df = df.filter(F.col(name).isNull() if value is None else F.col(name) == value)
    return df
