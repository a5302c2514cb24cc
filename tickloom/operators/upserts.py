"""Merges of incoming rows into a table. Each returns the table's new state; applying a batch twice changes nothing more."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import falsy_coalesce, pct_change, present

BAR = ("date", "open_price", "high_price", "low_price", "close_price", "volume", "change_percent")


def insert_if_absent(base: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """base and the incoming rows whose key it does not have; NULL keys equal each other. Of incoming rows with one key the
    first by ``order`` (by all columns if None) is taken."""
    by = [order] if order else [F.struct(*incoming.columns)]
    one = incoming.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_rn = 1").drop("_rn")
    a, b = one.alias("a"), base.select(*keys).distinct().alias("b")
    same = None
    for k in keys:
        test = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = test if same is None else same & test
    fresh = a.join(b, same, "left_anti")
    return base.unionByName(fresh.select(base.columns))


def seed_bars(incoming: DataFrame) -> DataFrame:
    """Bars as first stored: the change is that from open to close."""
    return incoming.withColumn("change_percent", pct_change(F.col("close_price"), F.col("open_price")))


def one_bar_a_day(incoming: DataFrame, order: list[str], keep_open: bool = True) -> DataFrame:
    """Incoming bars of one date as the bar that they give one after another, in ``order``.

    The last open that is not missing holds (the last one without ``keep_open``), extremes widen, the last close and change
    hold. Rows of equal order follow each other by all their columns.
    """
    line = F.struct(*order, *(c for c in BAR if c in incoming.columns))
    given = F.when(present(F.col("open_price")).isNotNull(), line) if keep_open else line
    return incoming.groupBy("date").agg(
        F.coalesce(F.max_by("open_price", given), F.max_by("open_price", line)).alias("open_price"),
        F.max("high_price").alias("high_price"),
        F.coalesce(F.min(present(F.col("low_price"))), F.min("low_price")).alias("low_price"),
        F.max_by("close_price", line).alias("close_price"),
        F.max_by("change_percent", line).alias("change_percent"),
    )


def merge_bars(base: DataFrame, incoming: DataFrame, keep_open: bool = True, order: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Daily bars merged by date: extremes widen, close and change are replaced, zero prices count as missing.

    Incoming bars of one date count one after another in ``order`` (that of all their columns if None). With ``keep_open`` a
    missing new open keeps the old one, else the new open always holds. ``keep`` names columns that an update leaves as they
    are: a realtime quote changes neither open_price nor change_percent of a stored bar. New days start with volume 0. Incoming
    rows without a date are left out.
    """
    one = one_bar_a_day(incoming.where(F.col("date").isNotNull()), order or [], keep_open)
    a, b = base.alias("a"), one.alias("b")
    both = a.join(b, F.col("a.date") == F.col("b.date"), "full_outer")
    hit, old = F.col("b.date").isNotNull(), F.col("a.date").isNotNull()
    new_open = falsy_coalesce(F.col("b.open_price"), F.col("a.open_price")) if keep_open else F.col("b.open_price")
    takes = lambda c: (hit & ~old) if c in keep else hit
    return both.select(
        F.coalesce("a.date", "b.date").alias("date"),
        F.when(takes("open_price"), new_open).otherwise(F.col("a.open_price")).alias("open_price"),
        F.greatest("a.high_price", F.when(hit & old, present(F.col("b.high_price"))).otherwise(F.col("b.high_price"))).alias("high_price"),
        F.least(F.when(hit, present(F.col("a.low_price"))).otherwise(F.col("a.low_price")), F.when(hit & old, present(F.col("b.low_price"))).otherwise(F.col("b.low_price"))).alias("low_price"),
        F.when(hit, F.col("b.close_price")).otherwise(F.col("a.close_price")).alias("close_price"),
        F.when(old, F.col("a.volume")).otherwise(F.lit(0)).alias("volume"),
        F.when(takes("change_percent"), F.col("b.change_percent")).otherwise(F.col("a.change_percent")).alias("change_percent"),
    )


def merge_quotes(base: DataFrame, quotes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Bars merged with realtime quotes, which change neither the open nor the change of a stored bar."""
    return merge_bars(base, quotes, order=order, keep=("open_price", "change_percent"))


def synthesize_bars(ticks: DataFrame, previous: DataFrame) -> DataFrame:
    """Bars from single prices: open is the close before, high and low lie around both. ticks(date, price),
    previous(date, close_price); without a close before, the price stands for it."""
    joined = ticks.join(previous.select("date", F.col("close_price").alias("prev")), "date", "left")
    prev = F.coalesce("prev", "price")
    return joined.select(
        "date",
        prev.alias("open_price"),
        F.greatest("price", prev).alias("high_price"),
        F.least("price", prev).alias("low_price"),
        F.col("price").alias("close_price"),
        F.lit(0).alias("volume"),
        pct_change(F.col("price"), prev).alias("change_percent"),
    )


def upsert_by_key(base: DataFrame, incoming: DataFrame, keys: list[str], defaults: dict, insert_only: tuple[str, ...] = (), order: str = "seq") -> DataFrame:
    """Rows merged by key: incoming values win, NULLs of new rows take the defaults, ``insert_only`` columns never change.

    Of incoming rows with one key the last by ``order`` holds, NULL being the first of all and equal ones following each other
    by all their columns. NULL keys equal each other.
    """
    total = [F.col(order).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in incoming.columns if c != order)]
    last = incoming.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*total))).where("_rn = 1")
    a, b = base.withColumn("_old", F.lit(True)).alias("a"), last.withColumn("_hit", F.lit(True)).alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    both = a.join(b, same, "full_outer")
    hit, old = F.coalesce("_hit", F.lit(False)), F.coalesce("_old", F.lit(False))
    out = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    for name in base.columns:
        if name in keys:
            continue
        new = F.coalesce(F.col(f"b.{name}"), F.lit(defaults[name])) if name in defaults else F.col(f"b.{name}")
        takes = hit & ~old if name in insert_only else hit
        out.append(F.when(takes, new).otherwise(F.col(f"a.{name}")).alias(name))
    return both.select(*out).select(base.columns)


def insert_counts(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many incoming rows ``insert_if_absent`` inserts and how many it skips."""
    known = base.select(*keys).distinct().withColumn("_known", F.lit(True)).alias("b")
    groups = incoming.groupBy(*keys).agg(F.count("*").alias("_rows")).alias("a")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    fresh = F.coalesce(F.count_if(F.col("_known").isNull()), F.lit(0))
    return groups.join(known, same, "left").agg(fresh.alias("inserted"), (F.coalesce(F.sum("_rows"), F.lit(0)) - fresh).alias("skipped"))
