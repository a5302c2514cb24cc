"""Freshness-gated serving and request limits."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import as_of, rolling_sums


def fresh_entries(entries: DataFrame, as_of: float, ttl: float) -> DataFrame:
    """entries(cache_key, ts in epoch seconds, ...) with age and whether it is under the time to live."""
    age = F.lit(float(as_of)) - F.col("ts")
    return entries.withColumns({"age": age, "fresh": age < ttl})


def cache_summary(entries: DataFrame, as_of: float, ttl: float) -> DataFrame:
    """Per key: number of entries, how many are fresh, the newest stamp."""
    return fresh_entries(entries, as_of, ttl).groupBy("cache_key").agg(F.count("*").alias("entries"), F.count_if("fresh").alias("fresh"), F.max("ts").alias("newest"))


def invalidate(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """entries without the keys; without any for None. Entries with a NULL key stay unless all go."""
    return entries.where(F.lit(False)) if keys is None else entries.where(F.coalesce(~F.col("cache_key").isin(keys), F.lit(True)))


def cache_keys(entries: DataFrame) -> DataFrame:
    """The keys that have an entry."""
    return entries.select("cache_key").distinct()


def serve(candidates: DataFrame, as_of: float, force: bool = False) -> DataFrame:
    """Per key the candidate of the lowest priority that is fresh.

    candidates(cache_key, priority, ts, ttl, value): a NULL ttl never goes stale, as that of a default document; the newest
    wins among equals, then the smallest value. Columns n_rows and least_rows, where there are both, gate a candidate that
    is made of stored rows: with fewer than least_rows it does not count. A column ``computed`` marks results of a fresh
    computation: with ``force`` those come first, whatever their priority; without it they wait for their turn.
    """
    good = F.col("ttl").isNull() | (F.lit(float(as_of)) - F.col("ts") < F.col("ttl"))
    if {"n_rows", "least_rows"} <= set(candidates.columns):
        good &= F.col("least_rows").isNull() | (F.coalesce("n_rows", F.lit(0)) >= F.col("least_rows"))
    if force and "computed" in candidates.columns:
        candidates = candidates.withColumn("priority", F.when(F.col("computed"), F.lit(-(2**31)).cast(candidates.schema["priority"].dataType)).otherwise(F.col("priority")))
    order = Window.partitionBy("cache_key").orderBy("priority", F.desc("ts"), "value")
    return candidates.where(good & F.col("value").isNotNull()).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def served_operations(operations: DataFrame, ttl: float, slice_seconds: float = 3_600) -> DataFrame:
    """Every get of operations(cache_key, ts, op, value) with what the cache holds then: ts, event (hit or miss), value and age.

    The batch form of ``streaming.cache.served``: op is put, remove or get, those of one time in that order; an entry is fresh for less
    than ``ttl`` seconds. Of puts of one time the one with the largest value holds. Rows without a time are left out.
    """
    timed = operations.where("ts IS NOT NULL").withColumn("cache_key", F.col("cache_key").cast("string"))
    # NULL is a key of a cache
    timed = timed.withColumn("__key", F.concat(F.lit("k"), "cache_key")).fillna({"__key": ""})
    gets, changes = timed.where("op = 'get'").select("cache_key", "ts", "__key"), timed.where("op IN ('put', 'remove')")
    changes = changes.withColumn("__rank", F.when(F.col("op") == "remove", 1).otherwise(0))
    found = as_of(gets, changes, "ts", {"value": "value", "__op": "op", "__at": "ts"}, slice_seconds, ("__key",), order=("__rank", "value"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    age = (micros("ts") - micros("__at")) / 1e6
    fresh = F.coalesce((F.col("__op") == "put") & (age < ttl), F.lit(False))
    return found.select("cache_key", "ts", F.when(fresh, "hit").otherwise("miss").alias("event"), F.when(fresh, F.col("value")).alias("value"), F.when(fresh, age).alias("age"))


def trailing_counts(requests: DataFrame, seconds: int, cap: int) -> DataFrame:
    """Per request(key, ts) the requests of its key in the last seconds, itself included, and whether they exceed the cap.

    All requests count, also those that a limiter would refuse; ``limit_requests`` has the exact rule. A key is counted in time
    slices, so a busy one is many tasks. Requests without a time are left out.
    """
    counted = rolling_sums(requests, {"n_window": F.lit(1)}, "ts", seconds, max(4 * seconds, 3_600), ("key",))
    return counted.withColumn("over_cap", F.col("n_window") > cap)


def limit_by_class(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """requests(key, class, ts) under limits(class, cap, seconds): each with ``allowed`` and, if refused, ``retry_after`` in seconds.

    A request is allowed if fewer than cap allowed requests of its key and class lie in the seconds before; a refused one may come
    back when the oldest of the last cap has left, never under a cap of 0 (NULL). Classes without a limit are allowed all. Acceptance
    feeds back, so each (key, class) is walked in order: Spark's sort brings its requests one after another, and the walk holds the
    last cap allowed times only. Requests without a time are left out. limits has one row a class.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    caps = limits.select(F.col("class").alias("__class"), F.greatest("cap", F.lit(0)).cast("long").alias("cap"), (F.col("seconds").cast("long") * 1_000_000).alias("span"))
    timed = requests.select("key", "class", micros.alias("at")).where("at IS NOT NULL").join(caps, F.col("class") == F.col("__class"), "left").drop("__class")
    free = timed.where("cap IS NULL").select("key", "class", "at", F.lit(True).alias("allowed"), F.lit(None).cast("double").alias("retry_after"))
    kinds = [requests.schema[c].dataType.simpleString() for c in ("key", "class")]

    def walk(batches):
        # no key equals the object that stands before the first
        last, times = object(), deque()
        for batch in batches:
            allowed, retry = [], []
            columns = [batch.column(c).to_pylist() for c in ("key", "class", "at", "cap", "span")]
            for key, kind, at, cap, span in zip(*columns, strict=True):
                own = ("NaN" if key != key else (key,), kind)  # NaN is one key
                if own != last:
                    last, times = own, deque(maxlen=cap)
                ok = len(times) < cap or (cap > 0 and times[0] <= at - span)
                retry.append(None if ok or not cap else (times[0] + span - at) / 1e6)
                allowed.append(ok)
                if ok:
                    times.append(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "class", "at")), pa.array(allowed, pa.bool_()), pa.array(retry, pa.float64())], ["key", "class", "at", "allowed", "retry_after"])

    capped = timed.where("cap IS NOT NULL").repartition("key", "class").sortWithinPartitions("key", "class", "at")
    walked = capped.mapInArrow(walk, f"key {kinds[0]}, class {kinds[1]}, at bigint, allowed boolean, retry_after double")
    return free.unionByName(walked).withColumn("at", F.timestamp_micros("at").cast(requests.schema["ts"].dataType)).withColumnRenamed("at", "ts")


def limit_requests(requests: DataFrame, seconds: int, cap: int) -> DataFrame:
    """requests(key, ts) with ``allowed``, under one limit for all; see ``limit_by_class``."""
    one = requests.sparkSession.range(1).select(F.lit("all").alias("class"), F.lit(cap).alias("cap"), F.lit(seconds).alias("seconds"))
    return limit_by_class(requests.select("key", F.lit("all").alias("class"), "ts"), one).select("key", "ts", "allowed")
