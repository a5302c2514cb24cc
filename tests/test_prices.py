import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions.exprs import market_rule, market_status, pct_change
from tickloom.operators import indicators, prices, upserts

BARS = "date date, open_price double, high_price double, low_price double, close_price double, volume int"
D = lambda s: dt.date.fromisoformat(s)


@pytest.fixture(scope="module")
def bars(spark):
    def make(*rows):
        return spark.createDataFrame([(D(r[0]), *r[1:]) for r in rows], BARS)

    return make


def test_missing_and_zero_lows(bars):
    df = bars(("2025-01-02", 10.0, 20.0, None, 15.0, 1), ("2025-01-03", 15.0, 21.0, 0.0, 16.0, 1), ("2025-01-06", 16.0, 19.0, 10.0, 17.0, 1))
    row = prices.stats_ytd(df, "2025-01-01").first()
    assert (row.min_price, row.min_date, row.max_price, row.max_date) == (10.0, "2025-01-06", 21.0, "2025-01-03")
    period = prices.period_extremes(df, "2025-01-31").first()
    assert (period.period_low, period.volatility_range) == (0.0, 0.0)


def test_current_price_can_be_the_extreme(bars):
    df = bars(("2025-01-02", 10.0, 20.0, 9.0, 15.0, 1))
    row = prices.stats_ytd(df, "2025-01-01", quote=30.0, as_of="2025-02-01").first()
    assert (row.max_price, row.max_date, row.ytd_return) == (30.0, "2025-02-01", 200.0)


def test_ties(bars):
    df = bars(("2025-01-02", 1.0, 5.0, 1.0, 2.0, 1), ("2025-01-03", 1.0, 5.0, 1.0, 2.0, 1))
    assert prices.stats_ytd(df, "2025-01-01").first().max_date == "2025-01-02"
    assert prices.period_extremes(df, "2025-01-31").first().period_high_date == D("2025-01-03")


def test_no_rows(bars):
    empty = bars().where("false")
    row = prices.stats_ytd(empty, "2025-01-01", quote=2700.0).first()
    assert (row.start_price, row.max_price, row.min_price, row.min_date) == (2633.0, 2700.0, 2633.0, "2025-01-02")
    assert prices.stats_ytd(empty, "2025-01-01").count() == 0
    assert prices.previous_close(empty).count() == 0 and prices.close_context(empty, None).count() == 0
    assert prices.axis_domain(empty).first()[:] == (0.0, 100.0)


def test_single_bar(bars):
    one = bars(("2025-01-02", 10.0, 20.0, 9.0, 15.0, 1))
    row = prices.previous_close(one).first()
    assert (row.prev_close, row.change) == (15.0, 0.0)
    month = prices.monthly_rollup(one).first()
    assert month.open == month.close and month.change == 0.0


def test_zero_base_gives_no_change(bars):
    df = bars(("2025-01-02", 0.0, 0.0, 0.0, 0.0, 1), ("2025-01-03", 1.0, 1.0, 1.0, 5.0, 1))
    assert prices.monthly_rollup(df).first().change == 0.0


@pytest.mark.parametrize(
    ("d", "y", "h", "label", "text"),
    [(1.0, 30.0, 1.0, "上涨", "趋势向好"), (2.0, -1.0, 1.0, "下跌", "短期承压"), (2.0, 5.0, 1.0, "震荡", "观望为主"), (-2.0, 30.0, 4.0, "回调", "正常调整"), (2.0, 30.0, 9.0, "强势上涨", "牛市延续"), (0.0, 0.0, 1.0, "高位震荡", "整理蓄势"), (0.0, 0.0, 9.0, "震荡", "方向不明"), (-2.0, 5.0, 9.0, "下跌", "短期承压")],
)
def test_market_rules(spark, d, y, h, label, text):
    rule = market_rule(F.lit(d), F.lit(y), F.lit(h))
    assert spark.range(1).select(market_status(rule, 0), market_status(rule, 1)).first()[:] == (label, text)


def test_overlay(spark, bars):
    daily = prices.date_range(bars(("2025-01-02", 1.0, 1.0, 1.0, 2.0, 7), ("2025-01-03", 1.0, 1.0, 1.0, 3.0, 8)))
    same = prices.overlay_daily(daily, "2025-01-03", 9.0).orderBy("date").collect()
    assert [tuple(r) for r in same] == [("2025-01-02", 2.0, 7), ("2025-01-03", 9.0, 0)]
    assert prices.overlay_daily(daily, "2025-01-04", 9.0).count() == 3
    assert prices.overlay_daily(daily, "2025-01-04", 9.0, end="2025-01-03").count() == 2
    assert prices.overlay_daily(daily.where("false"), "2025-01-03", 9.0).count() == 0
    pairs = spark.createDataFrame([(D("2025-01-02"), 1.0, 100.0)], "date date, gold_price double, dollar_index double")
    assert prices.overlay_aligned(pairs, "2025-01-03", 5.0).orderBy(F.desc("date")).first()[:] == (D("2025-01-03"), 5.0, 100.0)
    assert prices.overlay_aligned(pairs.where("false"), "2025-01-03", 5.0).count() == 0


def test_disjoint_series_do_not_align(bars):
    assert prices.align(bars(("2025-01-02", 1.0, 1.0, 1.0, 1.0, 1)), bars(("2025-01-03", 1.0, 1.0, 1.0, 1.0, 1))).count() == 0


def test_weekends_are_no_trading_days(bars):
    df = bars(("2025-01-03", 1.0, 1.0, 1.0, 1.0, 1), ("2025-01-04", 1.0, 1.0, 1.0, 1.0, 1), ("2025-01-05", 1.0, 1.0, 1.0, 1.0, 1))
    assert [str(r.date) for r in prices.trading_days(df).collect()] == ["2025-01-03"]


def test_quote_resolution(spark, bars):
    one = bars(("2025-01-02", 10.0, 20.0, 9.0, 15.0, 1))
    quotes = spark.createDataFrame([(1, None, None), (2, 7.0, 0.1), (3, 8.0, 0.2)], "priority int, price double, change_pct double")
    assert prices.resolve_quote(one, quotes).first().price == 7.0
    assert prices.resolve_quote(one, quotes.where("priority = 1")).first().price == 15.0
    assert prices.resolve_quote(one.where("false"), quotes.where("false")).count() == 0


def test_upserts_are_idempotent(bars):
    base = upserts.seed_bars(bars(("2025-01-02", 10.0, 20.0, 9.0, 15.0, 5), ("2025-01-03", 11.0, 21.0, 0.0, 16.0, 6)))
    new = upserts.seed_bars(bars(("2025-01-03", 0.0, 0.0, 8.0, 17.0, 9), ("2025-01-06", 12.0, 22.0, 7.0, 18.0, 9)))
    once = upserts.merge_bars(base, new)
    rows = sorted(map(tuple, once.collect()))
    assert rows[1][:6] == (D("2025-01-03"), 11.0, 21.0, 8.0, 17.0, 6) and rows[2][5] == 0
    assert sorted(map(tuple, upserts.merge_bars(once, new).collect())) == rows
    kept = upserts.insert_if_absent(base, new, ["date"])
    assert sorted(map(tuple, upserts.insert_if_absent(kept, new, ["date"]).collect())) == sorted(map(tuple, kept.collect()))


def test_null_keys_insert_once(spark):
    base = spark.createDataFrame([(None, "a")], "url string, title string")
    new = spark.createDataFrame([(None, "b"), ("u", "c"), ("u", "d")], "url string, title string")
    assert sorted((r.title) for r in upserts.insert_if_absent(base, new, ["url"]).collect()) == ["a", "c"]


def test_upsert_by_key_defaults(spark):
    base = spark.createDataFrame([("x", "old", "L")], "name string, impact string, logo string")
    new = spark.createDataFrame([("x", None, "M", 1), ("x", "high", "N", 2), ("y", None, "O", 3)], "name string, impact string, logo string, seq int")
    got = {r.name: (r.impact, r.logo) for r in upserts.upsert_by_key(base, new, ["name"], {"impact": "medium"}, ("logo",)).collect()}
    assert got == {"x": ("high", "L"), "y": ("medium", "O")}


def test_indicators(spark, bars):
    rows = [(f"2025-01-{d:02d}", float(d), float(d + 1), float(d), float(d), 1) for d in range(1, 31)]
    df = bars(*rows).withColumn("series", F.lit("gold"))
    last = indicators.rsi(indicators.bollinger(df, "series", 5), "series").orderBy(F.desc("date")).first()
    assert last.sma == 28.0 and last.rsi == 100.0
    assert indicators.bollinger(df, "series", 5).where("sma is null").count() == 4
    assert indicators.macd(df, "series").count() == 30 and indicators.support_resistance(df, "series", 5).orderBy(F.desc("date")).first().support == 26.0
    assert abs(indicators.trend(df).first().slope - 1) < 1e-9
    assert spark.range(1).select(pct_change(F.lit(1.0), F.lit(0.0))).first()[0] == 0.0


def test_repeated_dates_make_one_bar(bars):
    """Rows of one new date count one after another; applying them one by one gives the same."""
    base = upserts.seed_bars(bars(("2025-01-02", 10.0, 20.0, 9.0, 15.0, 5)))
    rows = [("2025-01-02", 11.0, 21.0, 0.0, 16.0, 1), ("2025-01-02", 0.0, 19.0, 8.0, 17.0, 2), ("2025-01-03", 5.0, 6.0, 4.0, 5.5, 3), ("2025-01-03", 0.0, 7.0, 0.0, 6.5, 4)]
    new = upserts.seed_bars(bars(*rows))
    got = sorted(map(tuple, upserts.merge_bars(base, new, order=["volume"]).collect()))
    one_by_one = base
    for row in rows[:4]:
        one_by_one = upserts.merge_bars(one_by_one, upserts.seed_bars(bars(row)))
    assert got == sorted(map(tuple, one_by_one.collect())) and len(got) == 2


def test_quotes_leave_open_and_change(bars):
    base = upserts.seed_bars(bars(("2025-01-02", 10.0, 20.0, 9.0, 15.0, 5)))
    row = upserts.merge_quotes(base, upserts.seed_bars(bars(("2025-01-02", 50.0, 60.0, 8.0, 40.0, 5)))).first()
    assert (row.open_price, row.high_price, row.low_price, row.close_price, row.change_percent) == (10.0, 60.0, 8.0, 40.0, 50.0)


def test_upsert_without_an_order_and_with_null_keys(spark):
    base = spark.createDataFrame([("a", "old"), (None, "old")], "name string, rating string")
    new = spark.createDataFrame([("a", "new", None), (None, "new", 1), ("b", "x", None), ("b", "y", None)], "name string, rating string, seq int")
    got = {r.name: r.rating for r in upserts.upsert_by_key(base, new, ["name"], {}).collect()}
    assert got == {"a": "new", None: "new", "b": "y"}


def test_insert_counts(spark):
    base, new = (spark.createDataFrame([(k,) for k in ks], "k string") for ks in (["a", None], ["a", "b", "b", None, "c"]))
    assert tuple(upserts.insert_counts(base, new, ["k"]).first()) == (2, 3)
    assert tuple(upserts.insert_counts(base, new.limit(0), ["k"]).first()) == (0, 0)


def test_overlay_carries_either_quote(spark):
    pairs = spark.createDataFrame([("2025-01-02", 10.0, 100.0)], "d string, gold_price double, dollar_index double").selectExpr("cast(d as date) as date", "gold_price", "dollar_index")
    pick = lambda **q: [(str(r.date), r.gold_price, r.dollar_index) for r in prices.overlay_aligned(pairs, "2025-01-03", **q).orderBy("date").collect()][1:]
    assert pick(dollar=101.0) == [("2025-01-03", 10.0, 101.0)] and pick(gold=11.0) == [("2025-01-03", 11.0, 100.0)] and pick() == []
