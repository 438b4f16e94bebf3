"""Keyed state machines: one pure step per machine, used by a batch form and by a Structured Streaming form.

Streaming forms use transformWithStateInPandas, so state lives in the state store of the query, keyed and fault tolerant.
Batch forms pass a key's sorted rows through once (machines.fold), so no key's rows are gathered. Event-time windows with a watermark are this engine's own late-data rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.streaming.machines import fold

# Fixed values of the machines.
EMA_ALPHA = 0.3
BURST, RATE = 30.0, 10.0
SESSION_S, RECYCLE = 1800, 100
CACHE_TTL_S = 90


class _Mean:
    """Rows with a value -> the mean so far."""

    def __init__(self, key: str, order: str, value: str):
        self.key, self.order, self.value, self.mean = key, order, value, None

    def step(self, row: dict) -> dict:
        x = row[self.value]
        self.mean = x if self.mean is None else EMA_ALPHA * x + (1 - EMA_ALPHA) * self.mean
        return {self.key: row[self.key], self.order: row[self.order], "ema": self.mean}


def ema(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Exponential mean of a key's values so far, the first one as start."""
    kinds = dict(events.dtypes)
    rows = events.select(key, order, F.col(value).cast("double").alias(value))
    return fold(rows, key, [order], lambda: _Mean(key, order, value), f"{key} {kinds[key]}, {order} {kinds[order]}, ema double")


def step_bucket(tokens: float, last: float, now: float, burst: float = BURST, rate: float = RATE) -> tuple[float, bool]:
    """Refill by the time passed, take one token if there is one."""
    tokens = min(burst, tokens + max(0.0, now - last) * rate)
    return (tokens - 1.0, True) if tokens >= 1.0 else (tokens, False)


class _Bucket:
    """Rows (at, event_id) -> whether a call is let through."""

    def __init__(self, key: str, burst: float, rate: float):
        self.key, self.burst, self.rate, self.tokens, self.last = key, burst, rate, burst, None

    def step(self, row: dict) -> dict:
        self.tokens, ok = step_bucket(self.tokens, row["at"] if self.last is None else self.last, row["at"], self.burst, self.rate)
        self.last = row["at"]
        return {"event_id": row["event_id"], self.key: row[self.key], "allowed": ok}


def token_bucket(events: DataFrame, key: str, ts: str, burst: float = BURST, rate: float = RATE) -> DataFrame:
    """events with ``allowed``, in event order for each key."""
    rows = events.select("event_id", key, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))
    return fold(rows, key, ["at", "event_id"], lambda: _Bucket(key, burst, rate), f"event_id long, {key} {dict(events.dtypes)[key]}, allowed boolean")


def cache_tiers(events: DataFrame, session: str, ts: str, fingerprint: Column, structure: Column) -> DataFrame:
    """tier A where the fingerprint is the last one of the session within the time to live, B where only its structure is, else C."""
    w = Window.partitionBy(session).orderBy(ts, "event_id")
    rows = events.withColumn("_f", fingerprint).withColumn("_s", structure)
    fresh = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) <= CACHE_TTL_S * 1_000_000
    tier = F.when(fresh & (F.lag("_f").over(w) == F.col("_f")), "A").when(fresh & (F.lag("_s").over(w) == F.col("_s")), "B").otherwise("C")
    return rows.withColumn("tier", tier).drop("_f", "_s")


class _Life:
    """Rows (t, event_id) -> the number of their session: a new one when the last is too old or was used too often."""

    def __init__(self, session: str):
        self.session, self.start, self.n, self.no = session, None, 0, 0

    def step(self, row: dict) -> dict:
        if self.start is None or row["t"] - self.start >= SESSION_S * 1_000_000 or self.n >= RECYCLE:
            self.start, self.n, self.no = row["t"], 0, self.no + 1
        self.n += 1
        return {self.session: row[self.session], "event_id": row["event_id"], "session_no": self.no}


def lifetimes(events: DataFrame, session: str, ts: str) -> DataFrame:
    """session number of each event: a new one when the last is SESSION_S old (from its start) or had RECYCLE events."""
    rows = events.select(session, "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    return fold(rows, session, ["t", "event_id"], lambda: _Life(session), f"{session} {dict(events.dtypes)[session]}, event_id long, session_no int")


def scroll_dedup(cards: DataFrame, session: str, order: str) -> DataFrame:
    """Cards with ``new``: the first of its key (url, else name and price, else name) in the session; cards without a key are new."""
    name = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    key = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("url:"), "url")).when((name != "") & F.col("price").isNotNull(), F.concat_ws(":", F.lit("np"), name, F.col("price").cast("string"))).when(name != "", F.concat(F.lit("n:"), name))
    w = Window.partitionBy(session, "_key").orderBy(order)
    return cards.withColumn("_key", key).withColumn("new", F.col("_key").isNull() | (F.row_number().over(w) == 1)).drop("_key")


# streaming forms


def windowed(stream: DataFrame, ts: str, late: str, size: str, slide: str | None, *keys: str) -> DataFrame:
    """Counts and sums per event-time window; rows later than ``late`` behind the newest are left out."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = stream.withWatermark(ts, late).groupBy(span, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, late: str, gap: str, key: str) -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def stream_ema(stream: DataFrame, key: str, value: str) -> DataFrame:
    """The exponential mean as a stateful stream: one update row per key and micro-batch."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Mean(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("ema", "m double")

        def handleInputRows(self, keys, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            m = self.state.get()[0] if self.state.exists() else None
            frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
            for x in frame[value]:
                m = x if m is None else EMA_ALPHA * x + (1 - EMA_ALPHA) * m
            self.state.update((m,))
            yield pd.DataFrame({key: [keys[0]], "ema": [m]})

        def close(self) -> None:
            pass

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(Mean(), f"{key} {kind}, ema double", "Update", "None")
