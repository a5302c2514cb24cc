import datetime as dt

import os

import pytest
from pyspark.sql import functions as F

from tickloom.operators import serving
from tickloom.operators.prices import overlay_aligned
from tickloom.operators.upserts import merge_bars
from tickloom.sources.tables import read_partitions, write_partitions
from tickloom.streaming import cache, market

T = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)


def drain(frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)


def stream(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_daily_bars_equal_the_batch(spark, tmp_path):
    ticks = spark.createDataFrame([(T(k * 97), float(k * 7919 % 100)) for k in range(60)], "ts timestamp, price double")
    drain(market.daily_bars(stream(spark, ticks, tmp_path / "t")), "bars", "complete")
    day = F.to_date("ts").alias("date")
    batch = ticks.groupBy(day).agg(F.min_by("price", "ts"), F.max("price"), F.min("price"), F.max_by("price", "ts"))
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, batch.collect()))


def test_news_once(spark, tmp_path):
    news = spark.createDataFrame([(f"u{k % 4}", T(k)) for k in range(12)], "url string, published_at timestamp")
    drain(market.distinct_news(stream(spark, news, tmp_path / "n")), "news_once", "append")
    assert spark.table("news_once").count() == 4


def test_limiter_equals_the_batch(spark, tmp_path):
    rows = [(f"k{k % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k * 5)) for k in range(90)]
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    drain(market.limited(stream(spark, df, tmp_path / "r"), 60, 2), "limited", "append")
    batch = serving.limit_requests(df, 60, 2)
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, batch.collect()))


def test_upsert_batches(spark, tmp_path):
    bars = "date date, open_price double, high_price double, low_price double, close_price double, volume int, change_percent double"
    state = {"path": None}

    def read():
        return spark.read.schema(bars).parquet(state["path"]) if state["path"] else spark.createDataFrame([], bars)

    def write(df, number):
        path = str(tmp_path / f"state{number}")
        df.write.mode("overwrite").parquet(path)
        state["path"] = path

    merge = market.upsert_into(read, write)
    day = dt.date(2024, 1, 1)
    merge(spark.createDataFrame([(day, 1.0, 2.0, 0.5, 1.5, 0, 0.0)], bars), 0)
    merge(spark.createDataFrame([(day, 0.0, 3.0, 1.0, 2.0, 0, 0.0)], bars), 1)
    assert read().first()[:5] == (day, 1.0, 3.0, 0.5, 2.0)


S = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
OPS = "cache_key string, ts timestamp, op string, value string"
BARS = "date date, open_price double, high_price double, low_price double, close_price double, volume int, change_percent double"


@pytest.fixture
def state_store(spark):
    for key, value in cache.STATE_STORE.items():
        spark.conf.set(key, value)
    yield
    for key in cache.STATE_STORE:
        spark.conf.unset(key)


class Cached:
    """A cache stream that takes files one batch after another and remembers its state."""

    def __init__(self, spark, path, ttl):
        self.spark, self.path, self.ttl, self.batches = spark, str(path), ttl, 0

    def run(self, rows):
        self.spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        stream = cache.served(self.spark.readStream.schema(OPS).parquet(f"{self.path}/in"), self.ttl, "0 seconds")
        out = f"{self.path}/out"
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{self.path}/cp").option("path", out).trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = [tuple(r) for r in self.spark.read.schema(cache.OUT).parquet(out).collect()]
        return sorted(got, key=str)

    def alive(self):
        """What state holds."""
        rows = self.spark.read.format("statestore").option("path", f"{self.path}/cp").option("stateVarName", "entry").load()
        return sorted(((r.key.cache_key, r.value.value) for r in rows.select("key", "value").collect()), key=str)


def test_cache_serves_expires_and_forgets(spark, tmp_path, state_store):
    cached = Cached(spark, tmp_path, 10)
    first = cached.run([("a", S(0), "put", "1"), ("a", S(4), "get", None), ("b", S(5), "put", "2"), ("c", S(5), "get", None), (None, S(5), "put", "n")])
    assert [r[:4] for r in first] == [("a", S(4), "hit", "1"), ("c", S(5), "miss", None)]
    assert cached.alive() == sorted([("a", "1"), ("b", "2"), (None, "n")], key=str)
    # a newer entry replaces the old one and its end; the watermark passes the others
    second = cached.run([("a", S(9), "put", "3"), ("a", S(12), "get", None), ("d", S(16), "get", None)])
    assert [r[:4] for r in second if r[2] == "expired"] == [("b", S(15), "expired", "2"), (None, S(15), "expired", "n")]
    assert ("a", S(12), "hit", "3") in [r[:4] for r in second] and cached.alive() == [("a", "3")]
    third = cached.run([("a", S(30), "get", None), ("b", S(30), "get", None), ("e", S(31), "put", "5"), ("e", S(32), "remove", None), ("e", S(32), "get", None)])
    assert {r[:3] for r in third} >= {("a", S(19), "expired"), ("a", S(30), "miss"), ("b", S(30), "miss"), ("e", S(32), "miss")}
    assert cached.alive() == []


def test_cache_stream_equals_the_batch(spark, tmp_path, state_store):
    ops = [(f"k{i % 3}", S(i * 7 % 200), ("put", "get", "get", "remove", "put")[i % 5], f"v{i}") for i in range(120)]
    got = Cached(spark, tmp_path, 25).run(ops)
    df = spark.createDataFrame(ops, OPS)
    batch = [tuple(r) for r in serving.served_operations(df, 25, 20).collect()]
    assert sorted((r for r in got if r[2] != "expired"), key=str) == sorted(batch, key=str)
    # what fresh_entries calls fresh is what a get of that moment hits
    as_of = S(60)
    puts = df.where("op = 'put' and ts <= timestamp'2024-01-01 00:01:00'").withColumn("ts", F.unix_timestamp("ts").cast("double"))
    newest = puts.groupBy("cache_key").agg(F.max("ts").alias("ts"))
    fresh = {r.cache_key for r in serving.fresh_entries(newest, as_of.replace(tzinfo=dt.timezone.utc).timestamp(), 25).where("fresh").collect()}
    asks = spark.createDataFrame([(f"k{i}", as_of, "get", None) for i in range(3)], OPS)
    hits = {r.cache_key for r in serving.served_operations(df.where("op = 'put' and ts <= timestamp'2024-01-01 00:01:00'").union(asks), 25, 20).where("event = 'hit'").collect()}
    assert hits == fresh


def test_partition_upserts_touch_only_their_months(spark, tmp_path):
    day = lambda m, d: dt.date(2024, m, d)
    base = spark.createDataFrame([(day(m, d), 1.0, 2.0, 0.5, 1.5, 0, 0.0) for m in (1, 2, 3) for d in (1, 2)], BARS)
    path, month = str(tmp_path / "bars"), F.date_format("date", "yyyy-MM")
    write_partitions(base, path, "month", month)

    def files():
        return {(m, f): os.stat(f"{path}/{m}/{f}").st_mtime_ns for m in os.listdir(path) if m.startswith("month=") for f in os.listdir(f"{path}/{m}")}

    before = files()
    batch = spark.createDataFrame([(day(2, 2), 0.0, 9.0, 0.1, 1.7, 0, 1.0), (day(4, 1), 3.0, 4.0, 2.0, 3.5, 0, 2.0), (None, 1.0, 1.0, 1.0, 1.0, 0, 0.0)], BARS)
    write = market.upsert_into_partitions(path, BARS)
    write(batch, 0)
    state = lambda: sorted(map(tuple, read_partitions(spark, path, BARS, "month").drop("month").collect()))
    want = sorted(map(tuple, merge_bars(base, batch).collect()))
    after = files()
    assert state() == want and len(want) == 7
    assert {k: v for k, v in before.items() if k[0] != "month=2024-02"} == {k: v for k, v in after.items() if k[0] in ("month=2024-01", "month=2024-03")}
    write(batch, 0)
    assert state() == want
    # the first batch makes the table, and a batch without dates does nothing
    fresh = str(tmp_path / "fresh")
    market.upsert_into_partitions(fresh, BARS)(batch.where("date is null"), 0)
    market.upsert_into_partitions(fresh, BARS)(base, 1)
    assert read_partitions(spark, fresh, BARS, "month").count() == 6


def test_quote_stream_equals_the_batch_overlay(spark, tmp_path):
    pairs = spark.createDataFrame([(dt.date(2024, 1, d), float(d), 100.0 + d) for d in (1, 2, 3)], "date date, gold_price double, dollar_index double")
    quotes = spark.createDataFrame([(dt.datetime(2024, 1, 4, h), g, d) for h, g, d in ((9, 50.0, None), (10, 51.0, None), (8, 49.0, None))], "ts timestamp, gold double, dollar double")
    state = {"path": str(tmp_path / "s")}
    pairs.write.parquet(state["path"])
    read = lambda: spark.read.parquet(state["path"])

    def write(df, number):
        path = str(tmp_path / f"s{number}")
        df.write.mode("overwrite").parquet(path)
        state["path"] = path

    market.overlay_stream(stream(spark, quotes, tmp_path / "q"), read, write, str(tmp_path / "cp"), once=True).awaitTermination(120)
    want = sorted(map(tuple, overlay_aligned(pairs, "2024-01-04", 51.0).collect()))
    rows = lambda: sorted(map(tuple, read().collect()))
    assert rows() == want and want[-1] == (dt.date(2024, 1, 4), 51.0, 103.0)
    market.overlay_into(read, lambda df, n: write(df, n + 10))(quotes, 0)
    assert rows() == want
    # a day in the middle takes what is before it; a quoted day without any value for a side is left out
    odd = spark.createDataFrame([(dt.datetime(2024, 1, 2), None, 7.0), (dt.datetime(2023, 12, 31), 1.0, None), (None, 1.0, 1.0), (dt.datetime(2024, 1, 6), None, None)], "ts timestamp, gold double, dollar double")
    market.overlay_into(read, lambda df, n: write(df, n + 20))(odd, 0)
    assert rows() == [(dt.date(2024, 1, 1), 1.0, 101.0), (dt.date(2024, 1, 2), 2.0, 7.0), (dt.date(2024, 1, 3), 3.0, 103.0), (dt.date(2024, 1, 4), 51.0, 103.0), (dt.date(2024, 1, 6), 51.0, 103.0)]


def test_quotes_meet_the_stored_series(spark, tmp_path):
    bars = spark.createDataFrame([("gold", dt.date(2024, 1, d), float(d)) for d in (1, 2, 5)], "series string, date date, close_price double")
    quotes = spark.createDataFrame([(dt.datetime(2024, 1, d, 12), s, 6.0) for d, s in ((1, "gold"), (2, "gold"), (4, "gold"), (5, "gold"), (9, "gold"), (9, "tin"))], "ts timestamp, series string, price double")
    drain(market.quote_changes(stream(spark, quotes, tmp_path / "q"), bars), "changes", "append")
    got = {(r.ts.day, r.series): (r.prev_close, r.change_pct) for r in spark.table("changes").collect()}
    assert got == {(1, "gold"): (None, None), (2, "gold"): (1.0, 500.0), (4, "gold"): (2.0, 200.0), (5, "gold"): (2.0, 200.0), (9, "gold"): (5.0, 20.0), (9, "tin"): (None, None)}
