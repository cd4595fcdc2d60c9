"""Rows of similar texts: an exact set-similarity join by shared subsets, weighted field similarity, groups.

Texts with equal word sets are one class; only class representatives are compared. Two sets of n and m words have Jaccard
similarity t or more just when they share k = ceil(t * (n + m) / (1 + t)) words, so each class of a short text is looked up
by all its subsets of the sizes k that its partners ask for: what meets is like, and the work grows with the rows however
few words there are. A text with more than ``MOST`` such subsets has too many of them. Where one of two texts is that
long, words are ordered from rare to usual; two sets share a word among their first n - ceil(t * n) + 1, so they are
looked up by those words only. All candidates are verified on whole sets. No pair above the threshold is lost. Null texts
and texts without words are like nothing.

Little goes over the network: a subset that only a whole set can meet is sent if a bit array of all whole sets may hold
it, and whole rows are read again only for the classes that candidates name. Both are broadcast within a bound; beyond it
more is sent and the pairs are the same.
"""

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.plans.lineage import cut

SALTS = 16
#: Subsets of one text at most, and words of a text whose subsets are looked at.
MOST, LONGEST = 128, 64
#: Bits of the array of whole sets, and rows that are broadcast to find others at most.
BITS, FEW = 1 << 26, 1 << 20


def _subsets(t: float) -> list[tuple[int, int, list[int], bool]]:
    """(n, k, places left out, whether only whole sets of k words meet it): the subsets by which sets of n words are looked up, for every n up to the first that has more than ``MOST``."""
    out: list[tuple[int, int, list[int], bool]] = []
    for n in range(1, LONGEST + 1):
        partners = range(math.ceil(t * n - 1e-6), min(math.floor(n / t + 1e-6), LONGEST) + 1)
        asked = [(k, m) for m in partners if (k := math.ceil(t * (n + m) / (1 + t) - 1e-6)) <= min(n, m)]
        shared = {k for k, _ in asked}
        if sum(math.comb(n, k) for k in shared) > MOST:
            break
        whole = {k: k < n and all(m == k for j, m in asked if j == k) for k in shared}
        out += [(n, k, list(gone), whole[k]) for k in sorted(shared) for gone in itertools.combinations(range(n), n - k)]
    return out


def narrowed(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is among the distinct ``ids`` (one column), found without moving ``df``; all rows where there are more than ``FEW`` ids."""
    few = ids.limit(FEW + 1).count() <= FEW
    return df.join(F.broadcast(ids), df[key] == ids[ids.columns[0]], "left_semi") if few else df


def ends(pairs: DataFrame) -> DataFrame:
    """(rep): the classes that pairs name."""
    return pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).distinct()


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _whole(hashes: str | Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda x, h: x.bitwiseXOR(h))


class WordSets:
    """The word sets of one table."""

    def __init__(self, df: DataFrame, row_id: str, text: Column, threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must lie in (0, 1]")
        self.threshold = threshold
        # Words hold no blanks, so that one string stands for a set.
        self.words = F.array_join(F.array_sort(F.array_distinct(T.words(F.col("text")))), " ").alias("words")
        self.texts = df.select(F.col(row_id).alias("row_id"), text.alias("text"))
        rows = self.texts.select("row_id", self.words).filter("row_id is not null and words <> ''")
        classes = rows.groupBy("words").agg(F.min("row_id").alias("rep"), F.max(F.size(F.split("words", " "))).alias("n"))
        self.sets = classes.filter("rep is not null").select("rep", "words", "n")
        #: (row_id, rep): every row with the least row of the same word set.
        self.members = rows.distinct().join(self.sets, "words").select("row_id", "rep")

    def _sized(self) -> DataFrame:
        """(rep, words, n, h, whole): every class with its words, their hashes and the hash of the set."""
        # Words depend on the length, which is an aggregate: no filter on them gets below the shuffle, so that all uses read the same one.
        words = F.split(F.when(F.col("n") > 0, F.col("words")), " ")
        return self.sets.select("rep", words.alias("words"), "n").withColumn("h", _hashes("words")).withColumn("whole", _whole("h"))

    def candidates(self) -> DataFrame:
        """(rep_a, whole_a, rep_b, whole_b), rep_a < rep_b: classes that share as many words as the threshold asks for, or rare words of long texts; ``whole`` is a hash of the set."""
        sized = self._sized()
        shapes = _subsets(self.threshold)
        longest = max((n for n, *_ in shapes), default=0)
        short = self._sharing(sized.filter(F.col("n") <= longest), shapes) if shapes else None
        long = self._prefixed(sized.filter(F.col("n") >= math.ceil(self.threshold * (longest + 1) - 1e-6)), longest)
        return (short.unionByName(long) if short else long).distinct()

    def _keys(self, sized: DataFrame, shapes: list[tuple[int, int, list[int], bool]]) -> DataFrame:
        """(rep, whole, n, k, subset): what each set is looked up by."""
        place = lambda c: F.shiftright(F.col(c).bitwiseAND(BITS - 1), 6)
        bit = lambda c: F.col(c).bitwiseAND(63).cast("int")
        there = sized.groupBy(place("whole").alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit("whole"))).alias("bits"))
        shape = F.broadcast(sized.sparkSession.createDataFrame(shapes, "n int, k int, gone array<int>, only_whole boolean"))
        left = F.aggregate("gone", F.col("whole"), lambda x, i: x.bitwiseXOR(F.get("h", i)))
        each = sized.join(shape, "n").select("rep", "whole", F.col("n").cast("tinyint").alias("n"), F.col("k").cast("tinyint").alias("k"), "only_whole", left.alias("subset"))
        held = each.withColumn("place", place("subset")).join(F.broadcast(there), "place", "left")
        return held.filter(~F.col("only_whole") | (F.getbit("bits", bit("subset")) == 1)).select("rep", "whole", "n", "k", "subset")

    def _sharing(self, sized: DataFrame, shapes: list[tuple[int, int, list[int], bool]]) -> DataFrame:
        t, keyed = self.threshold, self._keys(sized, shapes)
        a, b = keyed.alias("a"), keyed.alias("b")
        asked = F.ceil(F.lit(t) * (F.col("a.n").cast("int") + F.col("b.n")) / F.lit(1 + t) - 1e-6)
        met = a.join(b, (F.col("a.subset") == F.col("b.subset")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.rep") < F.col("b.rep")) & (F.col("a.k") == asked))
        return met.select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("rep", "whole")))

    def _prefixed(self, sized: DataFrame, longest: int) -> DataFrame:
        t = self.threshold
        words = sized.select("rep", "whole", "n", F.explode("words").alias("w"))
        usual = words.groupBy("w").agg(F.count("*").alias("f"))
        salted = words.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
        ranked = salted.join(usual.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["w", "salt"])
        rank = F.row_number().over(Window.partitionBy("rep", "whole").orderBy("f", "w"))
        prefix = ranked.withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9) + 1).select("rep", "whole", "n", "w", "salt")
        a = prefix.select(F.col("rep").alias("rep_a"), F.col("whole").alias("whole_a"), F.col("n").alias("na"), "w", "salt")
        b = prefix.drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(F.col("rep").alias("rep_b"), F.col("whole").alias("whole_b"), F.col("n").alias("nb"), "w", "salt")
        long = F.greatest("na", "nb")
        return a.join(b, ["w", "salt"]).filter((F.col("rep_a") < F.col("rep_b")) & (long > longest) & (F.least("na", "nb") >= long * t - 1e-9)).select("rep_a", "whole_a", "rep_b", "whole_b")

    def pairs(self) -> DataFrame:
        """(rep_a, rep_b, similarity), rep_a < rep_b: classes of Jaccard similarity ``threshold`` or more."""
        met = cut(self.candidates())
        texts = narrowed(self.texts, "row_id", ends(met)).select("row_id", self.words)
        named = texts.select(F.col("row_id").alias("rep"), F.split("words", " ").alias("words"))
        named = named.withColumn("whole", _whole(_hashes("words"))).groupBy("rep", "whole").agg(F.first("words").alias("words"))
        left, right = (named.select(F.col("rep").alias(f"rep_{s}"), F.col("whole").alias(f"whole_{s}"), F.col("words").alias(f"w{s}")) for s in "ab")
        both = met.join(left, ["rep_a", "whole_a"]).join(right, ["rep_b", "whole_b"])
        shared = F.size(F.array_intersect("wa", "wb"))
        return both.select("rep_a", "rep_b", (shared / (F.size("wa") + F.size("wb") - shared)).alias("similarity")).filter(F.col("similarity") >= self.threshold - 1e-9)

    def groups(self) -> DataFrame:
        """(row_id, class_id, group_id, n_links): the row's class, the least class it is linked to in any number of steps, and the number of classes like its own."""
        pairs = cut(self.pairs().select("rep_a", "rep_b"))
        ends = pairs.unionByName(pairs.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
        links = ends.groupBy("rep_a").agg(F.count("*").alias("n_links"))
        named = components(pairs.withColumnsRenamed({"rep_a": "a", "rep_b": "b"}))
        out = self.members.join(named.select(F.col("node").alias("rep"), "component"), "rep", "left").join(links.select(F.col("rep_a").alias("rep"), "n_links"), "rep", "left")
        return out.select("row_id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b): each node with the least node it is connected to.

    Alternates between linking greater neighbours to the least one and least ones to the node's neighbours, so that the
    number of rounds grows with the logarithm of the longest path; every round is a checkpoint, only its count is read.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = cut(small)
        if edges.count() == small.count() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def weighted(fields: dict[str, tuple[float, Column, Column]]) -> Column:
    """Word-set similarity of two rows over several fields (weight, left, right); weights of fields that one side lacks are shared out among the others. Null if no field is on both sides."""
    filled = {n: (a.isNotNull() & b.isNotNull() & (F.trim(a) != "") & (F.trim(b) != "")) for n, (_, a, b) in fields.items()}
    top = sum((F.when(filled[n], w * T.jaccard(a, b)).otherwise(0.0) for n, (w, a, b) in fields.items()), F.lit(0.0))
    weight = sum((F.when(filled[n], F.lit(w)).otherwise(0.0) for n, (w, _, _) in fields.items()), F.lit(0.0))
    return F.when(weight > 0, top / weight)


def label(similarity: Column) -> Column:
    return F.when(similarity >= 0.95, "exact").when(similarity >= 0.85, "near").when(similarity >= 0.7, "semantic").when(similarity.isNotNull(), "partial")
