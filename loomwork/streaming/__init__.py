"""Streaming forms of the time-based operators. Each takes a DataFrame, streaming or not, and gives the same rows for both.

Lateness is bounded by a watermark; rows later than it are dropped by a stream, never by a batch.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """A watermark needs a time with zone; texts and times without one are read in the session's zone."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], aggs: list[Column], late: str = "10 minutes") -> DataFrame:
    out = _timed(df, ts, late)
    return out.groupBy(F.window(ts, width), *by).agg(*aggs).select(F.col("window.start").alias("bucket"), *by, *[F.col(c) for c in _names(aggs)])


def sliding(df: DataFrame, ts: str, width: str, step: str, by: list[str], aggs: list[Column], late: str = "10 minutes") -> DataFrame:
    out = _timed(df, ts, late)
    return out.groupBy(F.window(ts, width, step), *by).agg(*aggs).select(F.col("window.start").alias("bucket"), *by, *[F.col(c) for c in _names(aggs)])


def sessions(df: DataFrame, ts: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    out = _timed(df, ts, late)
    return out.groupBy(by, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def first_seen(df: DataFrame, ts: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """One row per key within the watermark; state older than it is evicted."""
    if df.isStreaming:
        return _timed(df, ts, late).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def _names(aggs: list[Column]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggs]


BUCKET = "key string, event_id bigint, allowed boolean, tokens double"


def spend(tokens: float, last: float | None, now: float, rate: float, size: float) -> tuple[bool, float]:
    """One request against a token bucket: whether it is allowed and the tokens left."""
    filled = size if last is None else min(size, tokens + max(0.0, now - last) * rate)
    return (True, filled - 1) if filled >= 1 else (False, filled)


def token_bucket(df: DataFrame, key: str, event_id: str, ts: str, rate: float, size: float, idle_ms: int | None = None) -> DataFrame:
    """Each request of a key allowed or refused by a bucket of ``size`` tokens refilled at ``rate`` a second.

    A stream keeps (tokens, last time) per key and, with ``idle_ms``, forgets a key that is idle as long; a batch replays each key in time order.
    """
    source = df.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("bigint").alias("event_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    def replay(rows: pd.DataFrame, tokens: float, last: float | None) -> tuple[pd.DataFrame, float, float | None]:
        out = []
        for r in rows.sort_values(["us", "event_id"]).itertuples():
            allowed, tokens = spend(tokens, last, r.us / 1e6, rate, size)
            last = r.us / 1e6
            out.append((r.key, r.event_id, allowed, tokens))
        return pd.DataFrame(out, columns=["key", "event_id", "allowed", "tokens"]), tokens, last

    if df.isStreaming:
        def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            tokens, last = state.get if state.exists else (size, None)
            rows, tokens, last = replay(pd.concat(list(parts)), tokens, last)
            state.update((tokens, last))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
            yield rows

        return source.groupBy("key").applyInPandasWithState(step, BUCKET, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Partitions are sorted by key and time, so a key of any size passes through batch by batch.
        at, tokens, last = None, size, None
        for pdf in parts:
            for name, rows in pdf.groupby("key", sort=False):
                if name != at:
                    at, tokens, last = name, size, None
                out, tokens, last = replay(rows, tokens, last)
                yield out

    return source.filter("key is not null and us is not null").repartition("key").sortWithinPartitions("key", "us", "event_id").mapInPandas(whole, BUCKET)


def running_totals(batch: DataFrame, totals: DataFrame | None, by: list[str], value: str) -> DataFrame:
    """Totals after one micro-batch: count, sum, least and greatest, mergeable; for use in foreachBatch."""
    new = batch.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    if totals is None:
        return new
    return totals.unionByName(new).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


BREAKER = "key string, event_id bigint, sent boolean, state string"


def call(fails: int, opened: float | None, now: float, bad: bool, limit: int, pause: float) -> tuple[bool, int, float | None]:
    """One call against a breaker: whether it is sent, the failures on end and since when the breaker is open."""
    if opened is not None and now < opened + pause:
        return False, fails, opened
    fails = fails + 1 if bad else 0
    return True, fails, now if fails >= limit else None


def circuit_breaker(df: DataFrame, key: str, event_id: str, ts: str, failed: str, limit: int, pause: float) -> DataFrame:
    """Which calls of a key its breaker sends: closed until ``limit`` failures on end, open for ``pause`` seconds, then half open for one call.

    A call that is sent says in ``failed`` how it went. A stream keeps (failures, time of opening) per key; a batch
    streams each key in time order. Calls without a key or time are left out; a null in ``failed`` is a success.
    """
    source = df.select(F.col(key).cast("string").alias("key"), F.col(event_id).cast("bigint").alias("event_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.coalesce(F.col(failed), F.lit(False)).alias("bad")).filter("key is not null and us is not null")

    def replay(rows: pd.DataFrame, fails: int, opened: float | None) -> tuple[pd.DataFrame, int, float | None]:
        out = []
        for r in rows.sort_values(["us", "event_id"]).itertuples():
            sent, fails, opened = call(fails, opened, r.us / 1e6, bool(r.bad), limit, pause)
            out.append((r.key, r.event_id, sent, "closed" if opened is None else "open"))
        return pd.DataFrame(out, columns=["key", "event_id", "sent", "state"]), fails, opened

    if df.isStreaming:
        def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            fails, opened = state.get if state.exists else (0, None)
            rows, fails, opened = replay(pd.concat(list(parts)), fails, opened)
            state.update((fails, opened))
            yield rows

        return source.groupBy("key").applyInPandasWithState(step, BREAKER, "fails int, opened double", "append", GroupStateTimeout.NoTimeout)

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fails, opened = None, 0, None
        for pdf in parts:
            for name, rows in pdf.groupby("key", sort=False):
                if name != at:
                    at, fails, opened = name, 0, None
                out, fails, opened = replay(rows, fails, opened)
                yield out

    return source.repartition("key").sortWithinPartitions("key", "us", "event_id").mapInPandas(whole, BREAKER)
