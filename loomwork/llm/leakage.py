"""Evaluation passages in training text: hash-joined template windows with a check of slot consistency.

Every word is turned into a template token: a number becomes <num>, a unit <unit>, a name <name>, other words stay.
Windows of ``size`` template tokens of the evaluation items are hashed; a document's windows are joined with them by
hash. A joined pair of windows is then compared slot by slot: with equal words throughout it is 'verbatim'; with a
one-to-one mapping between the item's and the document's slot values it is 're-parameterised'; else it is dropped.

Words are runs of letters and digits in lower case. The type of a word that occurs in an item depends on the word
alone, never on its letter case in the document, so a verbatim passage in any letter case has equal templates. A word
that no item has is a name if the document writes it with a capital.

The evaluation set is a reference set of fixed size: it is collected, up to MAX_WINDOWS windows (more raise), and each
task holds it. Documents are processed whole. Null and empty texts give nothing; equal rows give one result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.plans.lineage import bounded_collect

MAX_ITEMS = 200_000
MAX_WINDOWS = 5_000_000
SCHEMA = "item_id bigint, doc_id bigint, kind string, n_windows int"
#: Words that name a unit.
UNITS = "mm cm m km inch inches feet foot yards yard miles mile metres meters metre meter grams gram g kg kilograms pounds lb oz ounces litres liters litre liter ml cl degrees percent seconds second minutes minute hours hour days day weeks week months month years year dollars euros cents bytes kb mb gb tb watts volts hertz hz".split()
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.uint64(BASE)
    return np.cumprod(out, dtype=np.uint64)


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values; the i-th belongs to values[i : i + size]."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j, p in enumerate(_powers(size)):
        out += values[j : j + n] * p
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


class Index:
    """The template windows of all items, sorted by hash, and the typing of the items' words."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.size, rng = size, np.random.default_rng(20240)
        texts = sorted({(int(i), t) for i, t in items if i is not None and t})
        inner, plain = set(), set()
        for _, text in texts:
            for m in WORD.finditer(text):
                before = text[: m.start()].rstrip()
                starts = not before or before[-1] in ".?!:"
                word = m.group()
                if word[:1].isupper() and not starts:
                    inner.add(word.lower())
                elif word[:1].islower():
                    plain.add(word)
        self.names = inner - plain
        words = sorted({w.lower() for _, t in texts for w in WORD.findall(t)})
        self.ids = {w: i + 1 for i, w in enumerate(words)}
        self.token = rng.integers(1, 2**63, size=len(words) + 4, dtype=np.uint64)
        self.num, self.unit, self.name = len(words) + 1, len(words) + 2, len(words) + 3
        self.types = np.arange(len(words) + 1, dtype=np.int64)
        for w, i in self.ids.items():
            self.types[i] = self._typed(w, i)
        self.items, hashes, owner, at = [], [], [], []
        for item, text in texts:
            seq = np.array([self.ids[w.lower()] for w in WORD.findall(text)], dtype=np.int64)
            h = window_hashes(self.token[self.types[seq]], size)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.items)))
            at.append(np.arange(len(h)))
            self.items.append((item, seq))
        if sum(map(len, hashes)) > MAX_WINDOWS:
            raise ValueError("the evaluation set is too large to be held by each task")
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        hashes, owner, at = cat(hashes, np.uint64), cat(owner, np.int64), cat(at, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.at = hashes[order], owner[order], at[order]
        self.filter = np.zeros(1 << 20, dtype=bool)  # by the hash's low 20 bits, before the exact search
        self.filter[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _typed(self, word: str, own: int) -> int:
        return self.num if word.isdigit() else self.unit if word in UNITS else self.name if word in self.names else own


class _Words(dict):
    """word as written -> (id, type) packed into one integer; unknown words get ids of their own below zero."""

    def __init__(self, index: Index):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> int:
        low, ix = word.lower(), self.index
        known = ix.ids.get(low)
        if known is not None:
            kind = int(ix.types[known])
        else:
            known = len(ix.ids) + 8 + (hash(low) & 0xFFFFFFF)
            kind = ix.num if low.isdigit() else ix.unit if low in UNITS else ix.name if word[:1].isupper() else 0
        if len(self) > 2_000_000:
            self.clear()
        self[word] = packed = known << 32 | kind
        return packed


def _consistent(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the slots map one to one."""
    pairs = set(zip(a.tolist(), b.tolist(), strict=True))
    return len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})


def scan(index: Index, ids: list, texts: list, words: _Words) -> list[tuple[int, int, str, int]]:
    """(item_id, doc_id, kind, windows) of one batch of documents."""
    packed, bounds, total = [], [], 0
    for text in texts:
        w = WORD.findall(text) if text else []
        packed.extend(map(words.__getitem__, w))
        bounds.append(total)
        total += len(w)
    if total < index.size or not len(index.hashes):
        return []
    both = np.fromiter(packed, dtype=np.int64, count=total)
    seq, kinds = both >> 32, both & 0xFFFFFFFF
    h = window_hashes(index.token[kinds], index.size)
    maybe = np.nonzero(index.filter[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
    lo, hi = np.searchsorted(index.hashes, h[maybe], "left"), np.searchsorted(index.hashes, h[maybe], "right")
    starts, found = np.array(bounds), {}
    for k in np.nonzero(hi > lo)[0]:
        at = int(maybe[k])
        doc = int(np.searchsorted(starts, at, "right")) - 1
        end = bounds[doc + 1] if doc + 1 < len(bounds) else total
        if at + index.size > end:
            continue
        own = seq[at : at + index.size]
        for x in range(int(lo[k]), int(hi[k])):
            item, words_of = index.items[int(index.owner[x])]
            other = words_of[int(index.at[x]) : int(index.at[x]) + index.size]
            kind = "verbatim" if np.array_equal(own, other) else "re-parameterised" if _consistent(own, other) else ""
            if kind:
                key = (item, int(ids[doc]), kind)
                found[key] = found.get(key, 0) + 1
    return [(*k, n) for k, n in found.items()]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 13) -> DataFrame:
    """(item_id, doc_id, kind, n_windows): each kind of match between an item and a document, once."""
    rows = bounded_collect(items.select(F.col(items.columns[0] if "item_id" not in items.columns else "item_id").alias("i"), F.col("text").alias("t")), MAX_ITEMS, "the evaluation set")
    index = Index([(r.i, r.t) for r in rows], size)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        words = _Words(ix)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                hits = scan(ix, part.column(0).to_pylist(), part.column(1).to_pylist(), words)
                cols = list(zip(*hits, strict=True)) if hits else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)], names=["item_id", "doc_id", "kind", "n_windows"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).filter("d is not null and t is not null")
    hits = source.mapInArrow(run, SCHEMA)
    return hits.groupBy("item_id", "doc_id", "kind").agg(F.max("n_windows").alias("n_windows"))


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents with at least 13 consecutive words of an item."""
    return leaks(docs, items).filter("kind = 'verbatim'").select("item_id", "doc_id").distinct()
