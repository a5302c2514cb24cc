"""Ingest in one pass: rows that fail a check go to an output of their own, and the write itself counts what it did."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: What the impact, rating and sentiment columns may hold.
ALLOWED = {"impact": ("high", "medium", "low"), "rating": ("bullish", "bearish", "neutral"), "sentiment": ("positive", "negative", "neutral")}


def factor_checks() -> dict[str, Column]:
    """Name to condition of what a stored factor needs."""
    return {
        "title": F.trim("title") != "",
        "impact": F.col("impact").isin(*ALLOWED["impact"]),
        "confidence": F.col("confidence").between(0.0, 1.0),
    }


def checked(df: DataFrame, checks: dict[str, Column], reason: str = "reason") -> DataFrame:
    """df with the name of the first check that a row fails, NULL where it passes all. A check that is NULL has failed."""
    failed = [F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()]
    return df.withColumn(reason, F.coalesce(*failed, F.lit(None).cast("string")))


def write_routed(df: DataFrame, checks: dict[str, Column], path: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): df written once, each row to the part of the table at ``path`` that its checks give.

    Good rows have the columns of df, rejected ones ``reason`` too; each is read from its own folder. Nothing is dropped and
    no row fails the job. df must not have columns named reason or rejected.
    """
    routed = checked(df, checks).withColumn("rejected", F.col("reason").isNotNull())
    routed.write.options(**options).partitionBy("rejected").parquet(path)
    table = df.sparkSession.read.schema(routed.schema).parquet(path)
    return table.where("not rejected").select(df.columns), table.where("rejected").drop("rejected")


def _counts(metrics: Observation, names: tuple[str, ...]) -> dict[str, int]:
    """The metrics once the write is over. Spark drops a part of a plan that it finds to be empty, and its metrics with it: none are 0."""
    row = metrics._jo.getRow()  # get() fails on a row without metrics
    return {name: int(row.getAs(name) or 0) if row.schema() is not None else 0 for name in names}


def insert_observed(base: DataFrame, incoming: DataFrame, keys: list[str], write: Callable[[DataFrame], None], order: str | None = None, checks: dict[str, Column] | None = None) -> dict[str, int]:
    """Hand the rows that ``insert_if_absent`` adds to ``write``; inserted, skipped and rejected counts come from that write.

    Rows that fail a check are rejected. Of the others with one key, the first by ``order`` (by all columns if None) is
    inserted unless base has the key; the rest are skipped. Repeats are counted before the shuffle, so a key with most of the rows
    is one row a task. ``write`` must run its frame exactly once.
    """
    refused, done = Observation(), Observation()
    rows = checked(incoming, checks or {}, "__reason").observe(refused, F.count_if(F.col("__reason").isNotNull()).alias("rejected")).where("__reason IS NULL")
    whole = F.struct(*incoming.columns)
    first = F.min(F.struct(F.col(order).alias("by"), whole.alias("row")) if order else F.struct(whole.alias("row")))
    groups = rows.groupBy(*keys).agg(first.alias("__first"), F.count("*").alias("__n"))
    known = base.select(*(F.col(k).alias(f"__b_{k}") for k in keys), F.lit(True).alias("__known")).distinct()
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in keys))
    fresh = F.col("__known").isNull()
    joined = groups.join(known, same, "left")
    counts = (F.count_if(fresh).alias("inserted"), (F.coalesce(F.sum("__n"), F.lit(0)) - F.count_if(fresh)).alias("skipped"))
    write(joined.observe(done, *counts).where(fresh).select("__first.row.*").select(base.columns))
    return _counts(done, ("inserted", "skipped")) | _counts(refused, ("rejected",))
