"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Token counts per document come from a public tokenizer (its file is a parameter), one Arrow batch at a time. Sources
are rows of a small target table (collected, up to MAX_SOURCES). The mix holds blocks of equal size, ``block_tokens`` or more where there would be over MAX_BLOCKS of them;
a block goes to the source with the highest quotient share / (2 * blocks + 1) that has not used up its capacity
max_repeats * tokens. Of the quotients only the threshold is searched, so the cost does not grow with the blocks. A
source cannot reach its share when the quotients would give it more blocks than its capacity holds; where the two lie
within one block of each other, the tokens themselves decide.

A source is spread over shards by a seeded hash, at most MAX_SHARDS in all and one more for each source, so that their
sums may be collected; a source's blocks are apportioned to its shards in the same way. In a shard the documents are
laid end to end in seeded order and cut into blocks; every pass takes all blocks, the last one as many as the quota has
left, from a seeded block on. A document belongs to the block in which it begins and is kept whole. ``shares`` measures
the shares of the chosen documents.

Null texts count no tokens; a source without documents has capacity zero; documents of unlisted sources count in the size of the corpus and are not chosen;
repeated rows of one document count once per row.
"""

import base64
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.plans.lineage import bounded_collect, cut

MAX_SOURCES, MAX_SHARDS, SHARD_TOKENS = 10_000, 50_000, 1 << 22
BLOCK_TOKENS, MAX_BLOCKS = 1024, 1_000_000
MAX_VOCABULARY = 64_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source"), tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and n_tokens of every document, whole texts."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    with open(tokenizer, "rb") as lines:
        content = lines.read(MAX_VOCABULARY + 1)
    if len(content) > MAX_VOCABULARY:
        raise ValueError("the tokenizer's file is too large to be held by each task")
    shipped = docs.sparkSession.sparkContext.broadcast(content)
    schema = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in keep) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return source.mapInArrow(run, schema)


def sainte_lague(weights: list[float], caps: list[int], blocks: int) -> list[int]:
    """Blocks per party by the highest quotients weight / (2q + 1); no party exceeds its cap. Ties: earlier party."""
    w, c = np.array(weights, dtype=float), np.array(caps, dtype=np.int64)
    c = np.where(w > 0, c, 0)
    total = int(min(blocks, c.sum()))
    given = lambda t: np.minimum(c, np.floor((w / t + 1) / 2).clip(0, 2**62).astype(np.int64))
    low, high = 0.0, 2 * max([*weights, 0.0]) + 1
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (low, middle) if given(middle).sum() <= total else (middle, high)
    seats = given(high)
    while seats.sum() < total:
        quotient = np.where(seats < c, w / (2 * seats + 1), -1.0)
        seats[int(np.argmax(quotient))] += 1
    return seats.tolist()


def plan(counts: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, size: float = 1.0) -> list[dict]:
    """One dict per source of the mix; ``size`` is the size of the mix over the size of the corpus."""
    listed = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    wanted = bounded_collect(listed, MAX_SOURCES, "the target table")
    by_source = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(listed.select("source", F.lit(True).alias("listed"))), "source", "left")
    sums = by_source.groupBy(F.when(F.col("listed"), F.col("source")).alias("source")).agg(F.sum("tokens").alias("tokens"))
    tokens = {r.source: int(r.tokens or 0) for r in bounded_collect(sums, MAX_SOURCES + 1, "the sums of the listed sources")}
    rows = sorted((r for r in wanted if r.source is not None), key=lambda r: r.source)
    have, total = [tokens.get(r.source, 0) for r in rows], sum(tokens.values())
    block = max(block_tokens, total // MAX_BLOCKS)
    blocks = int(total * size) // block
    shares = [float(r.target_share or 0) for r in rows]
    caps = [int(h * (r.max_repeats or 0) // block) for h, r in zip(have, rows, strict=True)]
    seats = sainte_lague(shares, caps, blocks)
    free = sainte_lague(shares, [blocks] * len(rows), blocks)
    out = []
    for r, h, s, f, cap, share in zip(rows, have, seats, free, caps, shares, strict=True):
        exact = int(r.max_repeats or 0) * h >= share * total * size
        reachable = exact if abs(cap - f) <= 1 else cap >= f
        out.append({"source": r.source, "target_share": share, "max_repeats": int(r.max_repeats or 0), "tokens": h, "block": block, "blocks": s, "reachable": reachable})
    return out


SHARES = "source string, target_share double, max_repeats int, tokens bigint, blocks bigint, mix_tokens bigint, passes double, actual_share double, reachable boolean"


def _shards(placed: DataFrame, sources: list[dict], seed: int) -> tuple[DataFrame, list[tuple]]:
    """``placed`` with its shard, and (source, shard, block, n_blocks, passes, extra, shift) of every shard."""
    total = sum(r["tokens"] for r in sources)
    width = max(SHARD_TOKENS, -(-total // MAX_SHARDS))
    spark = placed.sparkSession
    parts = spark.createDataFrame([(r["source"], -(-r["tokens"] // width) or 1) for r in sources if r["blocks"]], "source string, n_shards bigint")
    sharded = placed.join(F.broadcast(parts), "source").withColumn("shard", F.pmod("_h", "n_shards")).drop("n_shards")
    sums = bounded_collect(sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).orderBy("source", "shard"), MAX_SHARDS + MAX_SOURCES, "the shards")
    by_source: dict[str, list] = {}
    for r in sums:
        by_source.setdefault(r.source, []).append(r)
    quotas = []
    for own in sources:
        rows = by_source.get(own["source"], [])
        counts = [-(-r.n // own["block"]) for r in rows]
        seats = sainte_lague([float(r.n) for r in rows], [x * max(1, own["max_repeats"]) for x in counts], own["blocks"]) if rows else []
        for r, n, q in zip(rows, counts, seats, strict=True):
            quotas.append((r.source, r.shard, own["block"], n, q // n, q % n, random.Random(f"{seed}/{r.source}/{r.shard}").randrange(n)))
    return sharded, quotas


def selected(counts: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mix with their number of copies.

    ``counts``: (doc_id, source, n_tokens), read several times: a table or a checkpoint.
    """
    sources = plan(counts, targets, block_tokens)
    placed = counts.filter("n_tokens > 0").select("doc_id", "source", "n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("_h"))
    sharded, quotas = _shards(placed, sources, seed)
    names = "source string, shard bigint, block bigint, n_blocks bigint, passes bigint, extra bigint, shift bigint"
    table = counts.sparkSession.createDataFrame(quotas, names)
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("_h"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = sharded.withColumn("_start", F.sum("n_tokens").over(order) - F.col("n_tokens")).join(F.broadcast(table), ["source", "shard"])
    at = F.floor(F.col("_start") / F.col("block"))
    chosen = F.pmod(at + F.col("shift"), "n_blocks") < F.col("extra")
    copies = F.col("passes") + F.when(chosen, 1).otherwise(0)
    return begun.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).filter("copies > 0")


def shares(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """The plan as a table: target share of every source and the share that the chosen documents have of the mix."""
    counts = cut(token_counts(docs, tokenizer=tokenizer))
    rows = plan(counts, targets, block_tokens)
    got = selected(counts, targets, block_tokens, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n"))
    taken = {r.source: int(r.n) for r in bounded_collect(got, MAX_SOURCES, "the chosen sources")}
    total = max(1, sum(taken.values()))
    out = []
    for r in rows:
        n = taken.get(r["source"], 0)
        out.append((r["source"], r["target_share"], r["max_repeats"], r["tokens"], r["blocks"], n, n / r["tokens"] if r["tokens"] else 0.0, n / total, r["reachable"]))
    return docs.sparkSession.createDataFrame(out, SHARES)


def found(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source): each source to which the quotients would give more blocks than its capacity holds."""
    rows = plan(token_counts(docs, keep=("source",), tokenizer=tokenizer), targets)
    return docs.sparkSession.createDataFrame([(r["source"],) for r in rows if not r["reachable"]], "source string")
