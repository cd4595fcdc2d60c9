"""Cutting lineage in the shared folder the cluster names, so that a lost executor costs no recomputation."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def _ensure_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it must name a shared folder")
        folder = tempfile.mkdtemp(prefix="loomwork-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` read back from a reliable checkpoint in the folder of spark.checkpoint.dir."""
    _ensure_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def bounded_collect(df: DataFrame, limit: int, what: str) -> list:
    """The rows of a table that is small by definition; more than ``limit`` rows raise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it must be a small reference table")
    return rows
