"""A cache as a stream: keyed entries with a time to live, served, replaced, expired and removed by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need; set it before the stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "cache_key string, ts timestamp, event string, value string, age double"
#: Operations of one time take effect in this order.
RANK = {"put": 0, "remove": 1, "get": 2}


class _Entries(StatefulProcessor):
    """The newest entry of a key: (value, micros). A timer at the end of its life removes it."""

    def __init__(self, ttl: float):
        self.span = int(ttl * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, at bigint")

    def _drop(self, at: int) -> None:
        self.entry.clear()
        self.handle.deleteTimer(self._ends(at))

    def _ends(self, at: int) -> int:
        """The first millisecond at which the entry is no longer fresh."""
        return -(-(at + self.span) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))
        given = given.assign(rank=given["op"].map(RANK)).sort_values(["ts", "rank", "value"], kind="stable")
        found = self.entry.get() if self.entry.exists() else None
        stored, out = found, []
        for ts, op, value in zip(given["ts"], given["op"], given["value"], strict=True):
            at = int(ts.value // 1000)
            if op == "put":
                found = (value, at) if found is None or at >= found[1] else found
            elif op == "remove":
                found = None
            elif op == "get":
                fresh = found is not None and at - found[1] < self.span
                out.append((key[0], ts, "hit" if fresh else "miss", found[0] if fresh else None, (at - found[1]) / 1e6 if fresh else None))
        if found != stored:
            if stored is not None:
                self._drop(stored[1])
            if found is not None:
                self.entry.update(found)
                self.handle.registerTimer(self._ends(found[1]))
        yield _rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.entry.exists():
            yield _rows([])
            return
        value, at = self.entry.get()
        self.entry.clear()
        yield _rows([(key[0], pd.Timestamp((at + self.span) * 1000), "expired", value, self.span / 1e6)])


def _rows(out: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(out, columns=["cache_key", "ts", "event", "value", "age"])
    return df.astype({"ts": "datetime64[ns]", "age": "float64", "cache_key": object, "event": object, "value": object})


def served(operations: DataFrame, ttl: float, delay: str = "1 minute") -> DataFrame:
    """What a stream of operations(cache_key, ts, op, value) on a cache gives: hit or miss for every get, expired for entries that end.

    op is put, get or remove; others are ignored. An entry is fresh for less than ``ttl`` seconds of event time, as in
    ``serving.fresh_entries``; a newer put replaces it. Once the watermark has passed the end of its life, a timer removes it from
    state, so state holds the entries that are alive and no more. Operations later than the watermark are left out, as are those
    without a time; a NULL key is a key. Inside a batch, operations of a key take effect in order of time (put, remove, get at
    one time); between batches in order of arrival, with puts older than the entry ignored.
    """
    known = operations.where(F.col("op").isin(*RANK) & F.col("ts").isNotNull())
    plain = known.select(F.col("cache_key").cast("string").alias("cache_key"), F.col("ts").cast("timestamp").alias("ts"), "op", F.col("value").cast("string").alias("value"))
    keyed = plain.withWatermark("ts", delay).groupBy("cache_key")
    return keyed.transformWithStateInPandas(_Entries(ttl), OUT, "Append", "EventTime")
