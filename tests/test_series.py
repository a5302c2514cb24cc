"""Split series operators against plain Python, on random rows with ties, NULLs and slices of a few units."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators
from tickloom.operators import series as op

ROWS = "k string, n string, t long, o long, v double"


def rows_of(seed, n=120, nulls=True):
    rnd = random.Random(seed)
    maybe = lambda x, p=0.1: None if nulls and rnd.random() < p else x
    return [(maybe(rnd.choice("aab"), 0.05), rnd.choice("xy"), maybe(rnd.randint(-40, 40), 0.05), i, maybe(float(rnd.randint(-9, 9)), 0.3)) for i in range(n)]


def nearest(rows, key, t, forward, strict):
    """The row that an as-of join finds, by time and o."""
    if None in (*key, t):
        return None
    there = [r for r in rows if r[:2] == key and r[2] is not None and (r[2] >= t if forward else r[2] <= t) and not (strict and r[2] == t)]
    pick = (min if forward else max)(there, key=lambda r: (r[2], r[3]), default=None)
    return pick


@pytest.mark.parametrize("width", [1, 7, 1_000])
@pytest.mark.parametrize(("direction", "strict"), [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_as_of(spark, width, direction, strict):
    left, right = rows_of(1), rows_of(2)
    df = op.as_of(spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS), "t", {"v": "v", "found": "o"}, width, ("k", "n"), direction=direction, strict=strict, order=("o",))
    assert df.columns == ["k", "n", "t", "o", "v", "found"]  # v is that of the right side now
    got = {r.o: (r.v, r.found) for r in df.collect()}
    assert len(got) == len(left)
    for k, n, t, o, _ in left:
        row = nearest(right, (k, n), t, direction == "forward", strict)
        assert got[o] == ((row[4], row[3]) if row else (None, None))


def test_as_of_without_keys_and_empty_sides(spark):
    a = spark.createDataFrame([(5, "x"), (9, "y"), (None, "z")], "t int, n string")
    b = spark.createDataFrame([(1, 1.0), (8, None)], "u int, w double")
    got = op.as_of(a, b, "t", {"w": "w", "u": "u"}, 3, right_on="u").collect()
    assert {r.n: (r.w, r.u) for r in got} == {"x": (1.0, 1), "y": (None, 8), "z": (None, None)}
    assert op.as_of(a.limit(0), b, "t", {"w": "w"}, 3, right_on="u").count() == 0
    assert op.as_of(a, b.limit(0), "t", {"w": "w"}, 3, right_on="u").where("w is null").count() == 3
    with pytest.raises(ValueError, match="direction"):
        op.as_of(a, b, "t", {"w": "w"}, 3, right_on="u", direction="nearest")


@pytest.mark.parametrize("width", [1, 7, 1_000])
def test_carried_neighbours_positions_and_running_sums(spark, width):
    rows = rows_of(3)
    df, by = spark.createDataFrame(rows, ROWS), ("k", "n")
    timed = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[3]))
    line = {r[3]: [x for x in timed if x[:2] == r[:2]] for r in timed}
    carried = {r.o: r.v for r in op.carry_forward(df, ["v"], "t", width, by, ("o",)).collect()}
    near = {r.o: (r.prev_v, r.prev_o, r.next_o) for r in op.neighbours(df, ["v", "o"], "t", width, by, ("o",)).collect()}
    place = {r.o: r.position for r in op.positions(df, "t", width, by, ("o",)).collect()}
    summed = {r.o: (r.s, r.c) for r in op.running_sums(df, {"s": F.col("v"), "c": F.lit(1)}, "t", width, by).collect()}
    assert carried.keys() == near.keys() == place.keys() == summed.keys() == line.keys()
    for _, _, t, o, v in timed:
        own = line[o]
        i = [x[3] for x in own].index(o)
        before = [x[4] for x in own[: i + 1] if x[4] is not None]
        assert carried[o] == (before[-1] if before else None) and place[o] == i + 1
        assert near[o] == ((own[i - 1][4], own[i - 1][3]) if i else (None, None)) + (own[i + 1][3] if i + 1 < len(own) else None,)
        upto = [x[4] for x in own if x[2] <= t]
        some = [x for x in upto if x is not None]
        assert summed[o] == (sum(some) if some else None, len(upto))


@pytest.mark.parametrize("width", [1, 7, 1_000])
def test_rolling_sums_and_correlation(spark, width):
    rows = rows_of(4, 160)
    df = spark.createDataFrame(rows, ROWS).withColumn("w", F.col("v") * 2 + F.col("o") % 5)
    got = {r.o: (r.c, r.s) for r in op.rolling_sums(df, {"c": F.lit(1), "s": F.col("v")}, "t", 9, width, ("k",)).collect()}
    corr = {r.o: (r.n_rows, r.correlation) for r in op.rolling_correlation(df, "v", "w", "t", 9, width, ("k",), least=3).collect()}
    for k, _, t, o, _ in rows:
        if t is None:
            assert o not in got
            continue
        span = [r for r in rows if r[0] == k and r[2] is not None and t - 9 <= r[2] <= t]
        assert got[o] == (len(span), sum(r[4] or 0 for r in span))
        xy = [(r[4], r[4] * 2 + r[3] % 5) for r in span if r[4] is not None]
        assert corr[o][0] == len(xy)
        n, sx, sy = len(xy), sum(x for x, _ in xy), sum(y for _, y in xy)
        xx, yy, cross = n * sum(x * x for x, _ in xy) - sx * sx, n * sum(y * y for _, y in xy) - sy * sy, n * sum(x * y for x, y in xy) - sx * sy
        if n < 3:
            assert corr[o][1] is None
        elif xx > 1e-9 and yy > 1e-9:
            assert math.isclose(corr[o][1], cross / math.sqrt(xx * yy), abs_tol=1e-9)


def test_equal_values_have_no_correlation(spark):
    """Constants that are far from the key's mean leave rounding, which is no spread."""
    rows = [("a", t, 0.1 if t < 40 else 1e3 + t, float(t)) for t in range(60)]
    df = spark.createDataFrame(rows, "k string, t long, x double, y double")
    got = {r.t: r.correlation for r in op.rolling_correlation(df, "x", "y", "t", 9, 20, ("k",)).collect()}
    assert all(got[t] is None for t in range(40)) and all(abs(got[t] - 1) < 1e-6 for t in range(50, 60))


def test_times_of_all_kinds(spark):
    """Slices of dates are days, those of timestamps seconds."""
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + dt.timedelta(hours=7 * i), i) for i in range(40)], "ts timestamp, i int").withColumn("d", F.to_date("ts"))
    for on, width in (("ts", 3_600.0), ("ts", 86_400), ("d", 2), ("i", 1.5)):
        got = op.neighbours(df, ["i"], on, width, order=("i",)).collect()
        assert sorted((r.prev_i, r.i) for r in got if r.prev_i is not None) == [(i, i + 1) for i in range(39)]


def test_blocks_see_what_windows_look_back_to(spark):
    df = spark.createDataFrame([("a", i) for i in range(57)] + [("b", 3)], "k string, t int")
    blocks = op.in_blocks(df, "t", 10, 8, 3, ("k",)).collect()
    own = {(r.k, r.t): r.__getitem__("__block") for r in blocks if r["__own"]}
    assert len(own) == 58
    seen = {(r["__block"], r.k, r.t) for r in blocks}
    for (k, t), block in own.items():
        assert all((block, k, x) in seen for x in range(max(0, t - 3), t + 1) if k == "a")
    with pytest.raises(ValueError, match="block"):
        op.in_blocks(df, "t", 10, 2, 3, ("k",))


def test_indicators_do_not_depend_on_blocks(spark, monkeypatch):
    rnd = random.Random(6)
    day = dt.date(2020, 1, 1)
    rows = [(s, day + dt.timedelta(days=i), *(100 + rnd.gauss(0, 5) for _ in range(4))) for s in "ab" for i in range(150) if rnd.random() < 0.9]
    bars = spark.createDataFrame(rows, "series string, date date, open_price double, high_price double, low_price double, close_price double")
    closes = {s: [r[5] for r in rows if r[0] == s] for s in "ab"}

    def all_of(column, make):
        return {s: [r[column] for r in sorted(make(bars, "series").where(F.col("series") == s).collect(), key=lambda r: r.date)] for s in "ab"}

    makers = [("sma", indicators.bollinger), ("rsi", indicators.rsi), ("support", indicators.support_resistance), ("log_vol", indicators.log_volatility)]
    whole = [all_of(*m) for m in makers]
    monkeypatch.setattr(indicators, "BLOCK_ROWS", 20)
    monkeypatch.setattr(indicators, "SLICE_DAYS", 9)
    for a, b in zip(whole, (all_of(*m) for m in makers), strict=True):
        for s in "ab":
            assert [x is None for x in a[s]] == [x is None for x in b[s]]
            assert all(x is None or math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[s], b[s], strict=True))
    assert all(math.isclose(x, sum(closes[s][i - 19 : i + 1]) / 20) for s in "ab" for i, x in enumerate(whole[0][s]) if x is not None)


def test_macd_is_the_plain_recurrence_over_many_blocks(spark):
    rnd = random.Random(2)
    day = dt.date(2000, 1, 1)
    rows = [("a", day + dt.timedelta(days=i), 100 + rnd.gauss(0, 9) if i % 50 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "series string, date date, close_price double")
    got = {r.date: r.macd for r in indicators.macd(df, "series", 3, 9).collect()}
    fast = slow = None
    for _, d, x in rows:
        if x is None:
            assert d not in got
            continue
        fast, slow = (x, x) if fast is None else (fast * 0.5 + x * 0.5, slow * 0.8 + x * 0.2)
        assert math.isclose(got[d], fast - slow, abs_tol=1e-9)


def test_levels(spark):
    """Lows at 10, 10.05 and 12, highs at 20: the two close lows are one support."""
    lows, highs = [11, 10, 11, 10.05, 13, 12, 14, 15], [16, 17, 16, 20, 16, 17, 16, 15.5]
    day = dt.date(2024, 1, 1)
    rows = [(s, day + dt.timedelta(days=i), float(lo), float(hi), 15.0) for s in "ab" for i, (lo, hi) in enumerate(zip(lows, highs, strict=True))]
    df = spark.createDataFrame(rows, "series string, date date, low_price double, high_price double, close_price double")
    got = op.price_levels(df, 2, 0.01, 3, ("series",)).where("series = 'a'").collect()
    assert sorted((r.side, r["rank"], round(r.level, 3), r.touches) for r in got) == [("resistance", 1, 17.0, 2), ("resistance", 2, 20.0, 1), ("support", 1, 10.025, 2), ("support", 2, 12.0, 1)]
    one = op.price_levels(df.where("series = 'a'"), 2, 0.01, 1)
    assert sorted((r.side, round(r.level, 3)) for r in one.collect()) == [("resistance", 17.0), ("support", 10.025)]
    assert op.price_levels(df.limit(0), 2, by=("series",)).count() == 0


def test_a_busy_key_is_many_tasks(spark):
    """One key has all rows: its slices are dealt to several partitions, and no partition has most of them."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = op.running_sums(df, {"n": F.lit(1)}, "id", 500, ("k",)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(spread) > 2 and max(r["count"] for r in spread) < 12_000
