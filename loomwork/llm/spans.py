"""Long exact spans shared between records: relative Lempel-Ziv parsing against indexed reference blocks.

Every window of ``length`` characters belongs to one anchor: its k-gram of least hash (the leftmost of equals). Equal
windows have equal anchors at equal offsets, so the windows of an anchor that only one text has are shared by nobody;
such anchors are dropped by an aggregated count. A reference block is an anchor with the text of all windows it owns;
equal blocks are one class. The index of the blocks is keyed by (anchor, factor boundary, content): first for each bin
of boundaries by the characters that all factors starting in the bin have in common, then, for the bins that several
texts share, for every boundary by the whole window. No two blocks are ever compared with each other, so the cost is in
proportion to the blocks however many texts hold one anchor in different surroundings.

Parsing a text takes its indexed windows from left to right: a factor goes on while the following window stands at the
following place of the same reference, and a window begins the next factor where the one before ends. The reference of
a window is the least text that has it, for that text itself the greatest. Every factor has at least ``length``
characters and is checked at both boundaries, since its first and last window are found and the next ones are not.

Copies of one text are one class (by hash and length). ``found`` lists every pair, as its definition asks: each set of
texts that share some window is expanded once. ``factors`` and ``coverage`` stay linear.

Characters are code points. Null texts and texts shorter than ``length`` share nothing. Repeated rows count once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.plans.lineage import cut

LENGTH, GRAM, BIN, SALTS = 300, 150, 25, 16
BASE = 0x9E3779B97F4A7C15
BATCH_CHARS = 1_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def _inverse(b: int) -> int:
    """Of an odd number modulo 2 ** 64."""
    x = 1
    for _ in range(7):
        x = x * (2 - b * x) % (1 << 64)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value of each run of ``width`` values, the leftmost of equals."""
    n = len(values)
    rows = np.concatenate([values, np.full((-n) % width, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    index = np.arange(rows.size).reshape(rows.shape)
    ahead = np.minimum.accumulate(rows, axis=1)
    fresh = np.ones(rows.shape, dtype=bool)
    fresh[:, 1:] = rows[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(fresh, index, -1), axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)
    behind_at = np.minimum.accumulate(np.where(rows[:, ::-1] == behind, index[:, ::-1], rows.size), axis=1)[:, ::-1].ravel()
    first, last = behind_at[: n - width + 1], ahead_at[width - 1 : n]
    flat = rows.ravel()
    return np.where(flat[first] <= flat[last], first, last)


class Anchors:
    """Anchors of many texts at once: one polynomial prefix sum over their concatenation."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(index of the text, hash, position, least and greatest distance of an owned window's start) of each anchor.

        All texts are at least ``length`` long.
        """
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n, k, width = len(codes), self.gram, self.length - self.gram + 1
        if n > len(self.up):
            self.up, self.down = _powers(BASE, n + n // 4), _powers(_inverse(BASE), n + n // 4)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix(codes + np.uint64(1)) * self.up[:n], out=sums[1:])
        grams = _mix((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        least = _sliding_argmin(grams, width)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
        at = np.nonzero(np.arange(len(least)) + self.length <= ends[owner])[0]
        owner, place = owner[at], least[at]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        begin = np.nonzero(fresh)[0]
        end = np.append(begin[1:], len(at)) - 1
        own, place = owner[begin], place[begin]
        return own, grams[place], place - (ends - sizes)[own], place - at[end], place - at[begin]


def anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, t, at) for texts (t, text): the windows that the anchor at pos owns start at pos - hi to pos - lo; ``at`` packs the three (see ``unpacked``)."""
    names, base = ["h", "t", "at"], length - gram + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Anchors(length, gram)

        def flush(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            owner, h, pos, lo, hi = tool.of([r[1] for r in rows])
            t = np.array([r[0] for r in rows], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t[owner]), pa.array((pos * base + lo) * base + hi)], names=names)

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[1])
                if size > BATCH_CHARS:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return texts.mapInArrow(run, "h bigint, t bigint, at bigint")


def unpacked(df: DataFrame, length: int, gram: int) -> DataFrame:
    base = F.lit(length - gram + 2)
    place = F.floor(F.col("at") / (base * base))
    return df.select("*", place.cast("int").alias("pos"), F.pmod(F.floor(F.col("at") / base), base).cast("int").alias("lo"), F.pmod("at", base).cast("int").alias("hi")).drop("at")


def _salted(df: DataFrame) -> DataFrame:
    """``df`` once for every salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int").alias("salt")


class Spans:
    """The shared spans of one table of documents. Anchors are cheap to find and bulky to store, so both reads compute them."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM):
        if not 0 < gram < length < 30_000:
            raise ValueError("a gram must be shorter than a span, a span below 30,000 characters")
        self.length = length
        base = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
        base = base.select("doc", F.xxhash64("text").alias("t"), F.length("text").alias("n"), "text").filter(F.col("n") >= length)
        self.members = base.select("doc", "t", "n").distinct()
        copies = self.members.groupBy("t", "n").agg(F.min("doc").alias("rep"))
        found = anchors(base.select("t", "text"), length, gram)
        shared = found.groupBy("h").agg(F.min("t").alias("least"), F.max("t").alias("most")).filter("least <> most").select("h")
        kept = found.withColumn("salt", _salt("t")).join(_salted(shared), ["h", "salt"], "left_semi").drop("salt").distinct()
        texts = base.select(F.col("doc").alias("rep"), F.col("t").alias("_t"), "text")
        start, size = F.col("pos") - F.col("hi"), F.col("hi") - F.col("lo") + length
        located = unpacked(kept, length, gram).join(copies.select("t", "rep"), "t").join(texts, "rep").filter("t = _t").select("h", "rep", "pos", "lo", "hi", F.substring(F.col("text"), start + 1, size).alias("block"))
        #: (h, c, rep, pos, lo, hi, block): the reference blocks; c names the class of equal ones.
        self.blocks = cut(located.withColumn("c", F.xxhash64("block", "lo", "hi")).distinct())
        self.windows = cut(self._windows())

    def _windows(self) -> DataFrame:
        """(h, c, o, w, key): the windows of each class whose bin several texts share; o is the distance of the boundary from the anchor.

        Where all texts of a bin agree in every window of it, one row stands for the w windows o to o + w - 1.
        """
        classes = self.blocks.groupBy("h", "c").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("block").alias("block"))
        bins = classes.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / BIN).cast("int"), F.floor(F.col("hi") / BIN).cast("int"))))
        bins = bins.select("*", F.greatest(F.col("lo"), F.col("b") * BIN).alias("from"), F.least(F.col("hi"), F.col("b") * BIN + BIN - 1).alias("to"))
        part = lambda o, size: F.substring(F.col("block"), F.col("hi") - o + 1, size)
        whole = F.xxhash64("from", "to", part(F.col("to"), F.col("to") - F.col("from") + self.length))
        bins = bins.select("h", "c", "least", "most", "b", "from", "to", F.xxhash64(part(F.col("b") * BIN, F.lit(self.length - BIN + 1))).alias("k"), whole.alias("whole"), part(F.col("to"), F.col("to") - F.col("from") + self.length).alias("text"))
        several = bins.groupBy("h", "b", "k").agg(F.min("least").alias("least"), F.max("most").alias("most"), (F.min("whole") == F.max("whole")).alias("alike")).filter("least <> most").select("h", "b", "k", "alike")
        some = bins.withColumn("salt", _salt("c")).join(_salted(several), ["h", "b", "k", "salt"])
        each = some.withColumn("o", F.explode(F.when(F.col("alike"), F.array("from")).otherwise(F.sequence("from", "to"))))
        wide = F.when(F.col("alike"), F.col("to") - F.col("from") + 1).otherwise(1)
        key = F.when(F.col("alike"), F.col("whole")).otherwise(F.xxhash64(F.substring(F.col("text"), F.col("to") - F.col("o") + 1, F.lit(self.length))))
        return each.select("h", "c", "o", wide.alias("w"), key.alias("key"))

    def index(self) -> DataFrame:
        """(h, o, w, key, low, high, sign): the windows that stand in more than one text, with the least and the greatest place and a digest of the texts."""
        held = self.blocks.groupBy("h", "c").agg(F.min(F.struct("rep", "pos")).alias("low"), F.max(F.struct("rep", "pos")).alias("high"), F.count("*").alias("n"), *[F.sum(F.xxhash64("rep", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)])
        joined = self.windows.join(held, ["h", "c"])
        return joined.groupBy("h", "o", "w", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.struct(F.sum("n"), F.sum("s1"), F.sum("s2")).alias("sign")).filter("low.rep <> high.rep")

    def places(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (h, o, w, key, ...) with the (rep, s) of every place where the first of such windows starts."""
        classes = self.windows.withColumn("salt", _salt("c")).join(_salted(wanted), ["h", "o", "w", "key", "salt"]).drop("salt", "key")
        return classes.join(self.blocks.select("h", "c", "rep", "pos"), ["h", "c"]).withColumn("s", F.col("pos") - F.col("o") - F.col("w") + 1)

    def sets(self) -> DataFrame:
        """(g, rep): the different sets of texts that share a window, each once."""
        chosen = self.index().groupBy("sign").agg(F.min(F.struct("h", "o", "w", "key")).alias("x")).select("x.*", F.xxhash64("sign").alias("g"))
        return self.places(chosen).select("g", "rep").distinct()

    def membership(self) -> DataFrame:
        """(doc, rep): every document that is long enough with the least document of the same text."""
        return self.members.join(self.members.groupBy("t", "n").agg(F.min("doc").alias("rep")), ["t", "n"]).select("doc", "rep")

    def links(self) -> DataFrame:
        """(rep_a, rep_b), rep_a < rep_b: pairs of different texts, each named by its least document."""
        sets = cut(self.sets())
        a, b = sets.select("g", F.col("rep").alias("rep_a"), _salt("rep")), _salted(sets.select("g", F.col("rep").alias("rep_b")))
        return a.join(b, ["g", "salt"]).filter("rep_a < rep_b").select("rep_a", "rep_b").distinct()

    def found(self) -> DataFrame:
        """(doc_id_a, doc_id_b), a < b: every pair of documents that share a span."""
        members = self.membership()
        ma, mb = members.select(F.col("doc").alias("da"), F.col("rep").alias("rep_a")), members.select(F.col("doc").alias("db"), F.col("rep").alias("rep_b"))
        across = self.links().join(ma, "rep_a").join(mb, "rep_b").select("da", "db")
        copies = members.withColumn("salt", _salt("doc")).withColumnRenamed("doc", "da")
        within = copies.join(_salted(members.withColumnRenamed("doc", "db")), ["rep", "salt"]).filter("da < db").select("da", "db")
        return across.unionByName(within).filter("da <> db").select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b")).distinct()

    def factors(self) -> DataFrame:
        """(rep, start, size, ref, ref_start): the parse of every text with a shared window.

        ``ref`` is the text the factor was found in and ``ref_start`` its place there.
        """
        at = self.places(self.index().select("h", "o", "w", "key", "low", "high"))
        ref = F.when(F.col("rep") == F.col("low.rep"), F.col("high")).otherwise(F.col("low"))
        windows = at.select("rep", "s", "w", ref["rep"].alias("ref"), (ref["pos"] - F.col("o") - F.col("w") + 1).alias("r")).distinct()
        # Windows that follow each other in both texts are one factor: s less the windows before it is constant along it.
        runs = windows.withColumn("shift", F.col("s") - F.col("r"))
        order = Window.partitionBy("rep", "ref", "shift").orderBy("s")
        runs = runs.withColumn("island", F.col("s") + F.col("w") - F.sum("w").over(order)).groupBy("rep", "ref", "shift", "island").agg(F.min("s").alias("start"), F.max(F.col("s") + F.col("w") - 1).alias("last"))
        return runs.select("rep", "start", (F.col("last") - F.col("start") + self.length).alias("size"), "ref", (F.col("start") - F.col("shift")).alias("ref_start"))

    def coverage(self) -> DataFrame:
        """(doc_id, class_id, n_copies, n_factors, n_refs, shared_chars, n_chars): per document how much of it stands in some other document.

        ``class_id`` is the least document of the same text, ``n_refs`` the number of texts its factors were found in.
        """
        factors = self.factors()
        spans = factors.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e")))).alias("spans"), F.count("*").alias("n_factors"), F.count_distinct("ref").alias("n_refs"))
        begin = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("end"))
        merged = F.aggregate("spans", begin, lambda x, y: F.struct((x["sum"] + F.greatest(F.lit(0), y["e"] - F.greatest(y["s"], x["end"]))).alias("sum"), F.greatest(x["end"], y["e"]).alias("end")), lambda x: x["sum"])
        size = self.members.groupBy("t", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("n_copies"))
        rows = self.members.join(size, ["t", "n"]).join(spans.select("rep", "n_factors", "n_refs", merged.alias("shared")), "rep", "left")
        chars = F.when(F.col("n_copies") > 1, F.col("n").cast("bigint")).otherwise(F.coalesce("shared", F.lit(0).cast("bigint")))
        zero = F.lit(0).cast("bigint")
        return rows.select(F.col("doc").alias("doc_id"), F.col("rep").alias("class_id"), "n_copies", F.coalesce("n_factors", zero).alias("n_factors"), F.coalesce("n_refs", zero).alias("n_refs"), chars.alias("shared_chars"), F.col("n").cast("bigint").alias("n_chars")).filter("shared_chars > 0")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: pairs of documents that share a verbatim run of at least 300 characters."""
    return Spans(docs).found()
