"""Ordered operators for long series: as-of joins, carried values, running and rolling sums, neighbours, blocks of rows.

A window over a key puts all of its rows into one task. These operators cut the time axis into slices of ``width`` (days of
dates, seconds of timestamps, units of numbers), work inside (key, slice), and carry one row a slice over the slice's border. A
key with most of the rows is thus dealt to as many tasks as it has slices; only the rows of one slice, and one row for each
slice of a key, ever meet in a task. Choose a width that holds a few thousand to a million rows of the densest key.

Keys may be empty: the whole table is one series. Rows whose time is NULL have no place in an order: they get NULL from joins and are
left out elsewhere. A NULL key matches nothing in a join, and is a key like others elsewhere. Columns named like an output are
replaced; helper columns begin with two underscores.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000
#: Share of the mean square below which a variance is rounding.
NO_SPREAD = 1e-10


def ticks(df: DataFrame, on: str) -> tuple[Column, int]:
    """(time as a number, ticks in a unit of width): days, microseconds or the number itself."""
    kind = df.schema[on].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(on).cast("long"), 1
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(on).cast("timestamp")), MICROS
    return F.col(on), 1


def _keys(by: tuple[str, ...]) -> list[str]:
    return [f"__k{i}" for i in range(len(by))] or ["__k0"]


def _keyed(by: tuple[str, ...]) -> list[Column]:
    return [F.col(c).alias(k) for c, k in zip(by, _keys(by), strict=False)] or [F.lit(0).alias("__k0")]


def _sliced(df: DataFrame, width: float) -> DataFrame:
    return df.withColumn("__slice", F.floor(F.col("__t") / width))


def _carried(rows: DataFrame, per_slice: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of per_slice, one row for each key and slice; NULL keys equal each other."""
    names = [*keys, "__slice"]
    right = per_slice.select(*(F.col(c).alias(f"{c}_") for c in names), *(c for c in per_slice.columns if c not in names))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names))
    return rows.join(right, same, "left").drop(*(f"{c}_" for c in names))


def as_of(left: DataFrame, right: DataFrame, on: str, take: dict[str, str], width: float, by: tuple[str, ...] = (), right_on: str | None = None, direction: str = "backward", strict: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """left with columns of the right row that is the last at or before its time, or the first at or after it (``forward``).

    ``take`` maps new names to columns of right; all are NULL without such a row. ``strict`` leaves out rows of the same time. Of right
    rows with one time, the one farthest in the direction of the order holds: the last by ``order`` backward, the first forward. Right
    rows without key or time match nothing. Both sides are read twice, the second time for key, time and taken columns only.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, not {direction}")
    forward, keys = direction == "forward", _keys(by)
    sign = -1 if forward else 1
    own, unit = ticks(left, on)
    other, _ = ticks(right, right_on or on)
    rank = F.struct(other.alias("t"), *order)
    payload = F.struct(*(F.col(c).alias(n) for n, c in take.items()))
    there = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*by, right_on or on)))
    asking = left.select(*_keyed(by), (sign * own).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(True).alias("__asks"), F.struct(*left.columns).alias("__row"))
    giving = right.where(there).select(*_keyed(by), (sign * other).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.lit(False).alias("__asks"), rank.alias("__rank"), payload.alias("__payload"))
    both = _sliced(asking.unionByName(giving, allowMissingColumns=True), width * unit)
    inside = Window.partitionBy(*keys, "__slice").orderBy("__t", "__side", F.desc("__rank") if forward else F.asc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__found", F.last("__payload", ignorenulls=True).over(inside)).where("__asks")
    nearest = F.min_by if forward else F.max_by
    ends = both.groupBy(*keys, "__slice").agg(nearest("__payload", "__rank").alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__slice", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    found = F.when(F.col("__t").isNotNull(), F.coalesce("__found", "__carried"))
    if by:
        found = F.when(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)), found)
    out = _carried(rows, ends, keys).withColumn("__found", found)
    return out.select(*(F.col(f"__row.`{c}`").alias(c) for c in left.columns if c not in take), *(F.col(f"__found.`{n}`").alias(n) for n in take))


def carry_forward(df: DataFrame, columns: list[str], on: str, width: float, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Each NULL of the columns replaced by the key's last value before it that is not NULL, by time and ``order``."""
    keys = _keys(by)
    time, unit = ticks(df, on)
    rows = _sliced(df.select("*", *_keyed(by), time.alias("__t")).where("__t IS NOT NULL"), width * unit)
    inside = Window.partitionBy(*keys, "__slice").orderBy("__t", *order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct("__t", *order)
    ends = rows.groupBy(*keys, "__slice").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__end_{c}") for c in columns))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__slice", *(F.last(f"__end_{c}", ignorenulls=True).over(before).alias(f"__end_{c}") for c in columns))
    rows = rows.withColumns({f"__in_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    out = _carried(rows, ends, keys)
    return out.select(*(F.coalesce(f"__in_{c}", f"__end_{c}").alias(c) if c in columns else c for c in df.columns))


def neighbours(df: DataFrame, columns: list[str], on: str, width: float, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """df with prev_ and next_ of the columns: those of the key's row before and after, by time and ``order``."""
    keys = _keys(by)
    time, unit = ticks(df, on)
    rows = _sliced(df.select("*", *_keyed(by), time.alias("__t")).where("__t IS NOT NULL"), width * unit)
    line = Window.partitionBy(*keys, "__slice").orderBy("__t", *order)
    values, place = F.struct(*columns), F.struct("__t", *order)
    ends = rows.groupBy(*keys, "__slice").agg(F.max_by(values, place).alias("__last"), F.min_by(values, place).alias("__first"))
    slices = Window.partitionBy(*keys).orderBy("__slice")
    ends = ends.select(*keys, "__slice", F.lag("__last").over(slices).alias("__before"), F.lead("__first").over(slices).alias("__after"))
    rows = rows.withColumn("__own", values)
    rows = rows.withColumns({"__prev": F.lag("__own").over(line), "__next": F.lead("__own").over(line)})
    out = _carried(rows, ends, keys).withColumns({"__prev": F.coalesce("__prev", "__before"), "__next": F.coalesce("__next", "__after")})
    new = {f"{side}_{c}": F.col(f"__{side}.`{c}`") for c in columns for side in ("prev", "next")}
    return out.select(*(c for c in df.columns if c not in new), *(v.alias(n) for n, v in new.items()))


def running_sums(df: DataFrame, sums: dict[str, Column], on: str, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of each expression over the key's rows up to a row's time, rows of the same time included."""
    keys = _keys(by)
    time, unit = ticks(df, on)
    rows = _sliced(df.select("*", *_keyed(by), time.alias("__t"), *(e.alias(f"__v_{n}") for n, e in sums.items())).where("__t IS NOT NULL"), width * unit)
    upto = Window.partitionBy(*keys, "__slice").orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(*keys, "__slice").agg(*(F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__slice", *(F.sum(f"__s_{n}").over(before).alias(f"__s_{n}") for n in sums))
    rows = rows.withColumns({f"__in_{n}": F.sum(f"__v_{n}").over(upto) for n in sums})
    out = _carried(rows, totals, keys)
    total = {n: F.when(F.col(f"__in_{n}").isNull(), F.col(f"__s_{n}")).otherwise(F.col(f"__in_{n}") + F.coalesce(f"__s_{n}", F.lit(0))) for n in sums}
    return out.select(*(c for c in df.columns if c not in sums), *(e.alias(n) for n, e in total.items()))


def rolling_sums(df: DataFrame, sums: dict[str, Column], on: str, span: float, width: float, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the sum of each expression over the key's rows from ``span`` before a row's time up to it, both ends included.

    Each row enters at its time and leaves right after the span: running sums of both, whatever the number of rows in a
    span. What has entered and left cancels, so sums stay as small as a span's. NULLs count as nothing.
    """
    time, unit = ticks(df, on)
    rows = df.select(F.struct(*df.columns).alias("__row"), *(F.col(c).alias(f"__by_{c}") for c in by), time.alias("__at"), *(F.coalesce(e, F.lit(0)).alias(f"__e_{n}") for n, e in sums.items())).where("__at IS NOT NULL")
    # twice the time, and one more for those that leave
    events = F.array(F.struct((F.col("__at") * 2).alias("at"), F.lit(1).alias("sign")), F.struct(((F.col("__at") + span * unit) * 2 + 1).alias("at"), F.lit(-1).alias("sign")))
    moves = rows.select("*", F.explode(events).alias("__event")).select("*", F.col("__event.at").alias("__time"), F.col("__event.sign").alias("__sign"))
    moves = moves.withColumn("__row", F.when(F.col("__sign") == 1, F.col("__row")))
    summed = running_sums(moves, {n: F.col(f"__e_{n}") * F.col("__sign") for n in sums}, "__time", 2 * width * unit, tuple(f"__by_{c}" for c in by))
    return summed.where("__sign = 1").select(*(F.col(f"__row.`{c}`").alias(c) for c in df.columns if c not in sums), *sums)


def rolling_correlation(df: DataFrame, x: str, y: str, on: str, span: float, width: float, by: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """df with ``n_rows`` and ``correlation`` of x and y over the span before each row; NULL for less than ``least`` pairs or no spread.

    Co-moments are rolling sums of values less their key's mean; pairs with a NULL count as nothing. A variance of less than NO_SPREAD
    of the mean square is no spread.
    """
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    means = df.groupBy(*_keyed(by)).agg(F.avg(F.when(pair, F.col(x))).alias("__mx"), F.avg(F.when(pair, F.col(y))).alias("__my"))
    keys = _keys(by)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=False)), F.lit(True))
    centred = df.join(means, same, "left") if by else df.crossJoin(F.broadcast(means))  # one row without keys
    u, v = F.when(pair, F.col(x) - F.col("__mx")), F.when(pair, F.col(y) - F.col("__my"))
    sums = {"n_rows": F.when(pair, 1).otherwise(0), "__u": u, "__v": v, "__uu": u * u, "__vv": v * v, "__uv": u * v}
    out = rolling_sums(centred.drop(*keys), sums, on, span, width, by)
    n = F.col("n_rows")
    sx, sy, sxy = n * F.col("__uu") - F.col("__u") ** 2, n * F.col("__vv") - F.col("__v") ** 2, n * F.col("__uv") - F.col("__u") * F.col("__v")
    # what is left of equal values after rounding is no spread
    spread = (sx > NO_SPREAD * n * F.col("__uu")) & (sy > NO_SPREAD * n * F.col("__vv"))
    value = F.when((n >= least) & spread, sxy / F.sqrt(sx) / F.sqrt(sy))
    return out.select(*(c for c in df.columns if c not in ("n_rows", "correlation")), "n_rows", value.alias("correlation"))


def positions(df: DataFrame, on: str, width: float, by: tuple[str, ...] = (), order: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """df with each row's number in its key, from 1, by time and ``order``."""
    keys = _keys(by)
    time, unit = ticks(df, on)
    rows = _sliced(df.select("*", *_keyed(by), time.alias("__t")).where("__t IS NOT NULL"), width * unit)
    line = Window.partitionBy(*keys, "__slice").orderBy("__t", *order)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    counts = counts.select(*keys, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    out = _carried(rows.withColumn("__rn", F.row_number().over(line)), counts, keys)
    return out.select(*(c for c in df.columns if c != name), (F.col("__before") + F.col("__rn")).alias(name))


def in_blocks(df: DataFrame, on: str, width: float, rows: int, back: int, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """df with __position, __block and __own: blocks of ``rows`` rows of a key, each with copies of the ``back`` rows before it.

    Windows by (key, __block) that look back that far at most see all they need; keep the rows with __own afterwards.
    """
    if back > rows:
        raise ValueError("a block must hold as many rows as a window looks back")
    at = F.col("__position") - 1
    block = F.floor(at / rows)
    near = F.when(at % rows >= rows - back, F.array(block, block + 1)).otherwise(F.array(block))
    placed = positions(df, on, width, by, order, "__position").withColumn("__own", block)
    return placed.withColumn("__block", F.explode(near)).withColumn("__own", F.col("__own") == F.col("__block"))


def local_extrema(bars: DataFrame, width: float, by: tuple[str, ...] = (), on: str = "date") -> DataFrame:
    """(by, on, side, price): lows that are below both neighbours' (support) and highs that are above (resistance)."""
    near = neighbours(bars, ["low_price", "high_price"], on, width, by)
    low = (F.col("low_price") < F.col("prev_low_price")) & (F.col("low_price") < F.col("next_low_price"))
    high = (F.col("high_price") > F.col("prev_high_price")) & (F.col("high_price") > F.col("next_high_price"))
    sides = F.array(F.when(low, F.struct(F.lit("support").alias("side"), F.col("low_price").alias("price"))), F.when(high, F.struct(F.lit("resistance").alias("side"), F.col("high_price").alias("price"))))
    return near.select(*by, on, F.inline(F.filter(sides, lambda s: s.isNotNull())))


def price_levels(bars: DataFrame, width: float, tolerance: float = 0.01, most: int = 3, by: tuple[str, ...] = (), on: str = "date") -> DataFrame:
    """(by, side, rank, level, touches, last_touch): the ``most`` support and resistance levels of each series.

    Local extremes whose prices follow each other within the tolerance (a share of the lower one) are one level, at their
    mean; a gap starts another. Supports lie below the series' last close, resistances above. Levels with more touches come first,
    then those touched last, then lower ones. Prices that are not positive have no level.
    """
    extremes = local_extrema(bars, width, by, on).where("price > 0")
    # in steps of the tolerance, so that a slice of 1,000 holds many levels, and a level's gap is one step
    steps = F.ln("price") / math.log1p(tolerance)
    group = (*by, "side")
    line = neighbours(extremes.withColumn("__step", steps), ["price"], "__step", 1_000, group, (on,))
    starts = F.when(F.col("price") <= F.col("prev_price") * (1 + tolerance), 0).otherwise(1)
    numbered = running_sums(line.withColumn("__starts", starts), {"__cluster": F.col("__starts")}, "__step", 1_000, group)
    found = numbered.groupBy(*group, "__cluster").agg(F.avg("price").alias("level"), F.count("*").alias("touches"), F.max(on).alias("last_touch"))
    current = bars.groupBy(*_keyed(by)).agg(F.max_by("close_price", F.when(F.col("close_price").isNotNull(), F.col(on))).alias("__close"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, _keys(by), strict=False)), F.lit(True))
    found = found.join(current, same) if by else found.crossJoin(F.broadcast(current))  # one row without keys
    right_side = F.when(F.col("side") == "support", F.col("level") < F.col("__close")).otherwise(F.col("level") > F.col("__close"))
    best = Window.partitionBy(*group).orderBy(F.desc("touches"), F.desc("last_touch"), "level")
    ranked = found.where(right_side).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.select(*by, "side", "rank", "level", "touches", "last_touch")
