"""Cosine top-k of a stated query set against all rows, in blocks of queries held by each task."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def top_k(rows: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int) -> DataFrame:
    """(q, vec_id, rank) for each query; a row is no neighbour of itself. Null and zero vectors are left out.

    Queries are numbered into blocks of at most BLOCK; a block is one broadcast of bounded size and one pass over the
    rows, whose tasks keep the k best per query, so what is shuffled is k rows per query and task.
    """
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    hashed = queries.select(F.col(row_id).alias("q"), F.col(vector).alias("v")).filter("v is not null").withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        mine = hashed.filter(F.col("b") == b).orderBy("q").collect()
        ids = np.array([r.q for r in mine], dtype=np.int64)
        matrix = np.array([r.v for r in mine], dtype=np.float64).reshape(len(mine), -1)
        norms = np.linalg.norm(matrix, axis=1)
        shared = rows.sparkSession.sparkContext.broadcast((ids[norms > 0], matrix[norms > 0] / norms[norms > 0, None]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qs, unit = shared.value
            held_id, held = np.zeros((len(qs), 0), dtype=np.int64), np.zeros((len(qs), 0))
            for batch in batches:
                own, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                keep = [i for i, v in enumerate(vs) if v is not None and any(v)]
                if not keep or not len(qs):
                    continue
                x = np.array([vs[i] for i in keep], dtype=np.float64)
                who = np.array([own[i] for i in keep], dtype=np.int64)
                sims = np.round(unit @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 6)
                sims[qs[:, None] == who[None]] = -2
                held_id, held = np.concatenate([held_id, np.broadcast_to(who, sims.shape)], axis=1), np.concatenate([held, sims], axis=1)
                order = np.lexsort((held_id, -held), axis=1)[:, :k]
                held_id, held = np.take_along_axis(held_id, order, 1), np.take_along_axis(held, order, 1)
            good = held > -2
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, held.shape[1])[good.ravel()]), pa.array(held_id[good]), pa.array(held[good])], names=["q", "vec_id", "sim"])

        part = rows.select(F.col(row_id), F.col(vector)).filter(F.col(vector).isNotNull()).mapInArrow(run, "q bigint, vec_id bigint, sim double")
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("q", "vec_id", "rank")
