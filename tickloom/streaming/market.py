"""Structured Streaming forms of bar maintenance, realtime quotes, news ingest and the request limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.exprs import pct_change
from tickloom.operators.prices import overlay_quotes
from tickloom.operators.upserts import merge_bars
from tickloom.sources.tables import upsert_partitions


def daily_bars(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Daily bars of a tick stream(ts, price): first, highest, lowest and last price of each day; later ticks than the
    watermark are left out."""
    day = F.window("ts", "1 day")
    bars = ticks.withWatermark("ts", delay).groupBy(day).agg(
        F.min_by("price", "ts").alias("open_price"),
        F.max("price").alias("high_price"),
        F.min("price").alias("low_price"),
        F.max_by("price", "ts").alias("close_price"),
    )
    return bars.select(F.to_date("window.start").alias("date"), "open_price", "high_price", "low_price", "close_price")


def distinct_news(news: DataFrame, delay: str = "1 day", key: str = "url") -> DataFrame:
    """The first item of each key within the watermark."""
    return news.withWatermark("published_at", delay).dropDuplicatesWithinWatermark([key])


def upsert_into(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch of bars into a table; the writer gets the batch number, so that it can
    write each state to a place of its own and a repeated batch is harmless."""

    def merge(batch: DataFrame, number: int) -> None:
        write(merge_bars(read(), batch), number)

    return merge


def upsert_into_partitions(path: str, schema: str, merge: Callable[[DataFrame, DataFrame], DataFrame] = merge_bars) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges bars into a table by month; months that a batch doesn't touch are neither read nor
    written, so a batch costs what its days cost. A repeated batch is harmless."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            upsert_partitions(batch, path, schema, "month", F.date_format("date", "yyyy-MM"), merge)
        finally:
            batch.unpersist()

    return write


def overlay_into(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that lays a batch of quotes(ts, gold, dollar) over the stored aligned series.

    The writer gets the batch number, as in ``upsert_into``. Laying a batch over its own result changes nothing.
    """

    def overlay(batch: DataFrame, number: int) -> None:
        write(overlay_quotes(read(), batch), number)

    return overlay


def overlay_stream(quotes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds", once: bool = False) -> StreamingQuery:
    """Keep the aligned series up to date with a quote stream, a batch every few seconds; ``once`` takes what is there and ends."""
    writer = quotes.writeStream.foreachBatch(overlay_into(read, write)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def quote_changes(quotes: DataFrame, bars: DataFrame) -> DataFrame:
    """A quote stream(ts, series, price) with the close of the series' last stored day before the quote and the change to it.

    A stream-static join on the series and the day: ``bars`` (series, date, close_price) become the days from each close to the next, so a
    quote meets one row, whatever the length of the series. Quotes of unknown series keep NULLs.
    """
    line = Window.partitionBy("series").orderBy("date")
    days = bars.select(F.col("series").alias("__series"), F.col("date").alias("__from"), F.lead("date").over(line).alias("__to"), F.col("close_price").alias("prev_close"))
    day = F.to_date("ts")
    at = (F.col("series") == F.col("__series")) & (day > F.col("__from")) & (F.col("__to").isNull() | (day <= F.col("__to")))
    return quotes.join(days, at, "left").drop("__series", "__from", "__to").withColumn("change_pct", F.when(F.col("prev_close").isNotNull(), pct_change(F.col("price"), F.col("prev_close"))))


def limited(requests: DataFrame, seconds: int = 60, cap: int = 60, delay: str = "1 minute") -> DataFrame:
    """A request stream(key, ts) with ``allowed``: fewer than cap allowed requests of the key lie in the seconds before.

    Requests that come later than the watermark are left out. The state of a key are the times of its allowed requests, cap
    at most; it goes when the watermark has passed them by the window.
    """

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts")
        out, newest = [], max(times, default=0)
        for t in rows["ts"]:
            at = int(t.value // 1000)
            times = [x for x in times if x > at - seconds * 1_000_000]
            ok = len(times) < cap
            if ok:
                times.append(at)
            newest = max(newest, at)
            out.append((key[0], t, ok))
        state.update((times,))
        state.setTimeoutTimestamp(max(newest // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "allowed"])

    keyed = requests.withWatermark("ts", delay).groupBy("key")
    return keyed.applyInPandasWithState(walk, "key string, ts timestamp, allowed boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
