"""Cutting texts: chunkers that emit every character of a text once (apart from a stated overlap) and a summary of its weightiest sentences."""

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.functions.text import STOP_WORDS

CHUNK = "array<struct<chunk_no:int,start:int,chunk:string>>"


def by_chars(text: str, size: int, overlap: int = 0) -> list[dict]:
    """Pieces of at most ``size`` characters that end at a paragraph, else a sentence, if one ends past the middle; the next starts ``overlap`` back."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            for stop in ("\n\n", "\n", ". "):
                at = text.rfind(stop, start + max(size // 2, overlap + 1), end)
                if at > 0:
                    end = at + len(stop)
                    break
        out.append({"chunk_no": len(out), "start": start, "chunk": text[start:end]})
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def by_sentences(text: str, max_tokens: int) -> list[dict]:
    """Whole sentences packed up to ``max_tokens`` (four characters each); a longer sentence is a chunk of its own."""
    out, start, size = [], 0, 0
    ends = [m.end() for m in re.finditer(r"[.!?]+(?:\s+|$)", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    at = 0
    for end in ends:
        cost = (end - at + 3) // 4
        if size and size + cost > max_tokens:
            out.append({"chunk_no": len(out), "start": start, "chunk": text[start:at]})
            start, size = at, 0
        size, at = size + cost, end
    if start < len(text):
        out.append({"chunk_no": len(out), "start": start, "chunk": text[start:]})
    return out


def summary(text: str, share: float = 0.3, least: int = 3) -> str:
    """The sentences with the most frequent words per word, in their order; at least ``least``, ties to the earlier."""
    sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    words = [[w for w in re.findall(r"[^\W_]+", s.lower()) if len(w) > 2 and w not in STOP_WORDS] for s in sentences]
    counts: dict[str, int] = {}
    for ws in words:
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
    best = sorted(range(len(sentences)), key=lambda k: (-sum(counts[w] for w in words[k]) / max(1, len(words[k])), k))[: max(least, int(share * len(sentences)))]
    return " ".join(sentences[k] for k in sorted(best))


def normalised(text: str) -> str:
    """White space collapsed, tags removed, entities resolved, compatible characters unified."""
    plain = re.sub(r"<[^>]*>", " ", re.sub(r"\s+", " ", text))
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(plain))).strip()


def column(call, kind: str, c: Column, *args) -> Column:
    """``call`` over a text column in Arrow batches; null for null."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else call(x, *args) for x in s], dtype=object)

    return F.pandas_udf(run, kind)(c)
