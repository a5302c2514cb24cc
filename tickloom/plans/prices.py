"""Price queries on the test tables with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import indicators as ind
from tickloom.operators import prices as op
from tickloom.operators import upserts as up
from tickloom.sources.views import DOLLAR_SQL, GOLD_SQL, SERIES_SQL, dollar_bars, gold_bars, series_bars

ANCHOR, AS_OF, QUOTE = "2000-01-01", "2001-08-01", 250000.0

STATUS_SQL = """CASE WHEN d > 1 AND y > 20 THEN 'surge' WHEN d > 0 AND y > 10 THEN 'rise'
  WHEN d BETWEEN -1 AND 1 AND h < 3 THEN 'high' WHEN d BETWEEN -1 AND 1 THEN 'flat'
  WHEN d < 0 AND h < 5 THEN 'pullback' WHEN d < -1 OR y < 0 THEN 'fall' ELSE 'wait' END"""


def _round(df, digits, *columns):
    """Window averages differ in their last bits between engines; queries report them rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def stats_ytd(spark, sf_dir):
    bars = gold_bars(spark, sf_dir)
    return op.with_status(op.stats_ytd(bars, ANCHOR), op.previous_close(bars))


def _gold(run):
    return lambda spark, sf_dir: run(gold_bars(spark, sf_dir))


def _both(run):
    return lambda spark, sf_dir: run(gold_bars(spark, sf_dir), dollar_bars(spark, sf_dir))


def _series(run):
    return lambda spark, sf_dir: run(series_bars(spark, sf_dir))


def _halves(bars):
    """Test inputs of an upsert: bars of even days as the table, those of odd days and of days divisible by 3 as incoming, changed."""
    day = F.unix_date("date")
    base = up.seed_bars(bars.where(day % 2 == 0)).select(*up.BAR)
    new = bars.where((day % 2 == 1) | (day % 3 == 0))
    new = new.withColumns({"open_price": F.when(day % 5 == 0, 0.0).otherwise(F.col("open_price")), "high_price": F.when(day % 7 == 0, 0.0).otherwise(F.col("high_price") + 10), "low_price": F.col("low_price") - 10, "close_price": F.col("close_price") + 1})
    return base, up.seed_bars(new).select(*up.BAR)


def bar_upsert(bars):
    return up.merge_bars(*_halves(bars))


def bar_upsert_repeated(bars):
    """As bar_upsert, with a second row of each incoming date that comes first and has an open of its own."""
    base, new = _halves(bars)
    first = new.withColumns({"open_price": F.col("open_price") + 1, "low_price": F.col("low_price") - 1, "close_price": F.lit(1.0)})
    return up.merge_bars(base, first.withColumn("seq", F.lit(1)).unionByName(new.withColumn("seq", F.lit(2))), order=["seq"])


def quote_upsert(bars):
    return up.merge_quotes(*_halves(bars))


def bar_insert_counts(bars):
    return up.insert_counts(*_halves(bars), ["date"])


def bar_insert(bars):
    base, new = _halves(bars)
    return up.insert_if_absent(base, new, ["date"])


def dollar_upsert(bars):
    day = F.unix_date("date")
    ticks = bars.where((day % 2 == 1) | (day % 3 == 0)).select("date", F.col("close_price").alias("price"))
    before = bars.select(F.date_add("date", 1).alias("date"), "close_price")
    base = bars.where(day % 2 == 0).withColumns({"volume": F.lit(0), "change_percent": F.lit(0.0)}).select(*up.BAR)
    return up.merge_bars(base, up.synthesize_bars(ticks, before), keep_open=False)


def quote_or_history(bars):
    spark = bars.sparkSession
    quotes = spark.createDataFrame([(1, None, None), (2, QUOTE, 0.5)], "priority int, price double, change_pct double")
    return op.resolve_quote(bars, quotes)


QUERIES = {
    "stats_ytd": stats_ytd,
    "daily_range": _gold(lambda b: op.date_range(b, ANCHOR, AS_OF)),
    "daily_latest_n": _gold(lambda b: op.date_range(b, latest=90)),
    "latest_bar": _gold(op.latest_bar),
    "first_bar_since": _gold(lambda b: op.first_bar_since(b, ANCHOR)),
    "previous_close": _gold(op.previous_close),
    "monthly_rollup": _gold(lambda b: op.monthly_rollup(b, ANCHOR)),
    "monthly_rollup_desc": _gold(lambda b: op.monthly_rollup_latest(b, 12)),
    "aligned_series": _both(op.align),
    "aligned_latest": _both(lambda a, b: op.align(a, b, 100)),
    "aligned_corr": _both(lambda a, b: _round(ind.correlation(op.align(a, b)), 8, "correlation")),
    "period_extremes": _gold(lambda b: op.period_extremes(b, AS_OF)),
    "ytd_close_context": _gold(lambda b: op.close_context(b, ANCHOR)),
    "ytd_factor_context": _gold(lambda b: op.factor_context(b, ANCHOR)),
    "total_return_all": _gold(lambda b: op.close_context(b, None)),
    "trading_days_only": _gold(op.trading_days),
    "axis_domain": _gold(op.axis_domain),
    "overlay_daily": _gold(lambda b: op.overlay_daily(op.date_range(b, ANCHOR, AS_OF), AS_OF, QUOTE, AS_OF)),
    "overlay_aligned": _both(lambda a, b: op.overlay_aligned(op.align(a, b), AS_OF, QUOTE)),
    "overlay_carried": _both(lambda a, b: op.overlay_aligned(op.align(a, b), AS_OF, None, QUOTE)),
    "quote_or_history": _gold(quote_or_history),
    "bar_upsert": _gold(bar_upsert),
    "bar_upsert_repeated": _gold(bar_upsert_repeated),
    "quote_upsert": _gold(quote_upsert),
    "bar_insert_counts": _gold(bar_insert_counts),
    "bar_insert_if_absent": _gold(bar_insert),
    "dollar_synth_upsert": lambda spark, sf_dir: dollar_upsert(dollar_bars(spark, sf_dir)),
    "sma_bollinger": _series(lambda b: _round(ind.bollinger(b, "series"), 4, "sma", "upper", "lower")),
    "rsi": _series(lambda b: _round(ind.rsi(b, "series"), 4, "rsi")),
    "macd": _series(lambda b: _round(ind.macd(b, "series"), 4, "macd")),
    "support_resistance": _series(lambda b: ind.support_resistance(b, "series")),
    "log_volatility": _series(lambda b: _round(ind.log_volatility(b, "series"), 8, "log_vol")),
    "trend_line": _gold(lambda b: _round(ind.trend(b), 4, "slope", "intercept")),
    "outlier_filter": _gold(lambda b: ind.without_outliers(b.select("date", F.col("close_price").alias("price")), z=1.5)),
}

_G = f"WITH {GOLD_SQL}"
_GD = f"WITH {GOLD_SQL}, {DOLLAR_SQL}"
_PAIRS = "pairs AS (SELECT g.date, g.close_price AS gold_price, d.close_price AS dollar_index FROM gold g JOIN dollar d USING (date))"
_CLOSE = """, y AS (SELECT * FROM gold {where}), o AS (SELECT
  (SELECT close_price FROM y ORDER BY date LIMIT 1) AS start_price, (SELECT close_price FROM y ORDER BY date DESC LIMIT 1) AS current_price,
  max(close_price) AS max_price, min(close_price) AS min_price,
  (SELECT date FROM y ORDER BY close_price DESC, date LIMIT 1) AS max_date, (SELECT date FROM y ORDER BY close_price, date LIMIT 1) AS min_date FROM y)
SELECT *, (current_price - start_price) / start_price * 100 AS return_pct, (max_price - min_price) / min_price * 100 AS volatility FROM o"""
_PREV = """p AS (SELECT date, close_price, coalesce(lag(close_price) OVER (ORDER BY date), close_price) AS prev_close FROM gold),
q AS (SELECT *, (close_price - prev_close) / prev_close * 100 AS change FROM p ORDER BY date DESC LIMIT 1)"""
_DAY = "CAST(date - DATE '1970-01-01' AS INTEGER)"
_HALVES = f""", seeded AS (SELECT *, {_DAY} AS n FROM gold),
base AS (SELECT date, open_price, high_price, low_price, close_price, volume, (close_price - open_price) / open_price * 100 AS change_percent FROM seeded WHERE n % 2 = 0),
inc0 AS (SELECT date, CASE WHEN n % 5 = 0 THEN 0.0 ELSE open_price END AS open_price, CASE WHEN n % 7 = 0 THEN 0.0 ELSE high_price + 10 END AS high_price,
  low_price - 10 AS low_price, close_price + 1 AS close_price, volume FROM seeded WHERE n % 2 = 1 OR n % 3 = 0),
inc AS (SELECT *, CASE WHEN open_price = 0 THEN 0.0 ELSE (close_price - open_price) / open_price * 100 END AS change_percent FROM inc0)"""
_S = f"WITH {SERIES_SQL}"
_BARS = "series, date, open_price, high_price, low_price, close_price"
_LINE = "OVER (PARTITION BY series ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"

ORACLE = {
    "stats_ytd": f"""{_G},
year AS (SELECT * FROM gold WHERE date >= DATE '{ANCHOR}'),
last2 AS (SELECT date, close_price, row_number() OVER (ORDER BY date DESC) AS rn FROM gold),
one AS (SELECT (SELECT close_price FROM last2 WHERE rn = 1) AS cur, (SELECT date FROM last2 WHERE rn = 1) AS today,
  coalesce((SELECT close_price FROM last2 WHERE rn = 2), (SELECT close_price FROM last2 WHERE rn = 1)) AS prev,
  (SELECT CASE WHEN coalesce(open_price, 0) = 0 THEN close_price ELSE open_price END FROM year ORDER BY date LIMIT 1) AS start,
  (SELECT max(high_price) FROM year) AS hi, (SELECT date FROM year ORDER BY high_price DESC, date LIMIT 1) AS hid,
  (SELECT min(low_price) FROM year) AS lo, (SELECT date FROM year ORDER BY low_price, date LIMIT 1) AS lod),
two AS (SELECT *, greatest(hi, cur) AS mx, least(lo, cur) AS mn, (cur - start) / start * 100 AS y FROM one),
three AS (SELECT *, (cur - prev) / prev * 100 AS d, (mx - cur) / mx * 100 AS h FROM two),
four AS (SELECT *, {STATUS_SQL} AS rule FROM three)
SELECT cur AS current_price, start AS start_price, y AS ytd_return, mx AS max_price, mn AS min_price,
  CAST(CASE WHEN mx = cur THEN today ELSE hid END AS VARCHAR) AS max_date,
  CAST(CASE WHEN mn = cur THEN today ELSE lod END AS VARCHAR) AS min_date,
  (mx - mn) / mn * 100 AS volatility,
  CASE rule WHEN 'surge' THEN '强势上涨' WHEN 'rise' THEN '上涨' WHEN 'high' THEN '高位震荡' WHEN 'flat' THEN '震荡'
    WHEN 'pullback' THEN '回调' WHEN 'fall' THEN '下跌' ELSE '震荡' END AS market_status,
  CASE rule WHEN 'surge' THEN '牛市延续' WHEN 'rise' THEN '趋势向好' WHEN 'high' THEN '整理蓄势' WHEN 'flat' THEN '方向不明'
    WHEN 'pullback' THEN '正常调整' WHEN 'fall' THEN '短期承压' ELSE '观望为主' END AS market_status_desc
FROM four""",
    "daily_range": f"{_G} SELECT CAST(date AS VARCHAR) AS date, close_price AS price, volume FROM gold WHERE date BETWEEN DATE '{ANCHOR}' AND DATE '{AS_OF}'",
    "daily_latest_n": f"{_G} SELECT CAST(date AS VARCHAR) AS date, close_price AS price, volume FROM gold ORDER BY gold.date DESC LIMIT 90",
    "latest_bar": f"{_G} SELECT * FROM gold ORDER BY date DESC LIMIT 1",
    "first_bar_since": f"{_G} SELECT * FROM gold WHERE date >= DATE '{ANCHOR}' ORDER BY date LIMIT 1",
    "previous_close": f"{_G}, {_PREV} SELECT * FROM q",
    "monthly_rollup": f"""{_G}, m AS (SELECT strftime(date, '%Y-%m') AS month, arg_min(close_price, date) AS open, arg_max(close_price, date) AS close,
  min(coalesce(nullif(low_price, 0), close_price)) AS low, max(coalesce(nullif(high_price, 0), close_price)) AS high FROM gold WHERE date >= DATE '{ANCHOR}' GROUP BY 1)
SELECT *, (close - open) / open * 100 AS change FROM m""",
    "monthly_rollup_desc": f"""{_G}, r AS (SELECT * FROM gold ORDER BY date DESC LIMIT 360),
m AS (SELECT strftime(date, '%Y-%m') AS month, arg_max(coalesce(nullif(open_price, 0), close_price), date) AS open, arg_min(close_price, date) AS close FROM r GROUP BY 1)
SELECT *, (close - open) / open * 100 AS change FROM m ORDER BY month DESC LIMIT 12""",
    "aligned_series": f"{_GD}, {_PAIRS} SELECT * FROM pairs",
    "aligned_latest": f"""{_GD} SELECT g.date, g.close_price AS gold_price, d.close_price AS dollar_index
FROM (SELECT * FROM gold ORDER BY date DESC LIMIT 100) g JOIN (SELECT * FROM dollar ORDER BY date DESC LIMIT 100) d USING (date)""",
    "aligned_corr": f"{_GD}, {_PAIRS} SELECT round(corr(gold_price, dollar_index), 8) AS correlation, count(*) AS n_days FROM pairs",
    "period_extremes": f"""{_G}, y AS (SELECT * FROM gold WHERE date <= DATE '{AS_OF}'), o AS (SELECT max(high_price) AS period_high,
  (SELECT date FROM y ORDER BY high_price DESC, date DESC LIMIT 1) AS period_high_date, min(low_price) AS period_low,
  (SELECT date FROM y ORDER BY low_price, date DESC LIMIT 1) AS period_low_date FROM y)
SELECT *, (period_high - period_low) / period_low * 100 AS volatility_range FROM o""",
    "ytd_close_context": _G + _CLOSE.format(where=f"WHERE date >= DATE '{ANCHOR}'"),
    "ytd_factor_context": f"""{_G}, {_PREV}, s AS (SELECT close_price AS start_price FROM gold WHERE date >= DATE '{ANCHOR}' ORDER BY date LIMIT 1)
SELECT q.*, s.start_price, (close_price - start_price) / start_price * 100 AS ytd_change FROM q, s""",
    "total_return_all": _G + _CLOSE.format(where=""),
    "trading_days_only": f"{_G} SELECT * FROM gold WHERE isodow(date) < 6",
    "axis_domain": f"{_G}, o AS (SELECT min(close_price) AS lo, max(close_price) AS hi FROM gold) SELECT greatest(0, lo - (hi - lo) * 0.1::DOUBLE) AS low, hi + (hi - lo) * 0.1::DOUBLE AS high FROM o",
    "overlay_daily": f"""{_G} SELECT CAST(date AS VARCHAR) AS date, close_price AS price, volume FROM gold WHERE date BETWEEN DATE '{ANCHOR}' AND DATE '{AS_OF}' AND date <> DATE '{AS_OF}'
UNION ALL SELECT '{AS_OF}', {QUOTE}, 0""",
    "overlay_aligned": f"""{_GD}, {_PAIRS} SELECT * FROM pairs WHERE date <> DATE '{AS_OF}'
UNION ALL SELECT DATE '{AS_OF}', {QUOTE}, (SELECT dollar_index FROM pairs ORDER BY date DESC LIMIT 1)""",
    "overlay_carried": f"""{_GD}, {_PAIRS} SELECT * FROM pairs WHERE date <> DATE '{AS_OF}'
UNION ALL SELECT DATE '{AS_OF}', (SELECT gold_price FROM pairs ORDER BY date DESC LIMIT 1), {QUOTE}""",
    "quote_or_history": f"SELECT 2 AS priority, {QUOTE}::DOUBLE AS price, 0.5::DOUBLE AS change_pct",
    "bar_upsert": f"""{_G}{_HALVES} SELECT coalesce(b.date, i.date) AS date,
  CASE WHEN i.date IS NULL THEN b.open_price ELSE coalesce(nullif(i.open_price, 0), b.open_price) END AS open_price,
  CASE WHEN i.date IS NULL THEN b.high_price WHEN b.date IS NULL THEN i.high_price ELSE greatest(b.high_price, coalesce(nullif(i.high_price, 0), b.high_price)) END AS high_price,
  CASE WHEN i.date IS NULL THEN b.low_price WHEN b.date IS NULL THEN i.low_price ELSE least(b.low_price, coalesce(nullif(i.low_price, 0), b.low_price)) END AS low_price,
  coalesce(i.close_price, b.close_price) AS close_price, CASE WHEN b.date IS NULL THEN 0 ELSE b.volume END AS volume,
  CASE WHEN i.date IS NULL THEN b.change_percent ELSE i.change_percent END AS change_percent
FROM base b FULL JOIN inc i ON b.date = i.date""",
    "bar_upsert_repeated": f"""{_G}{_HALVES} SELECT coalesce(b.date, i.date) AS date,
  CASE WHEN i.date IS NULL THEN b.open_price WHEN i.open_price <> 0 THEN i.open_price WHEN i.open_price + 1 <> 0 THEN i.open_price + 1 ELSE b.open_price END AS open_price,
  greatest(b.high_price, CASE WHEN b.date IS NULL THEN i.high_price ELSE nullif(i.high_price, 0) END) AS high_price,
  least(CASE WHEN i.date IS NULL THEN b.low_price ELSE nullif(b.low_price, 0) END, least(nullif(i.low_price - 1, 0), nullif(i.low_price, 0))) AS low_price,
  CASE WHEN i.date IS NULL THEN b.close_price ELSE i.close_price END AS close_price, coalesce(b.volume, 0) AS volume,
  CASE WHEN i.date IS NULL THEN b.change_percent ELSE i.change_percent END AS change_percent
  FROM base b FULL JOIN inc i ON b.date = i.date""",
    "quote_upsert": f"""{_G}{_HALVES} SELECT coalesce(b.date, i.date) AS date,
  CASE WHEN b.date IS NULL THEN nullif(i.open_price, 0) ELSE b.open_price END AS open_price,
  greatest(b.high_price, CASE WHEN b.date IS NULL THEN i.high_price ELSE nullif(i.high_price, 0) END) AS high_price,
  least(CASE WHEN i.date IS NULL THEN b.low_price ELSE nullif(b.low_price, 0) END, CASE WHEN b.date IS NULL THEN i.low_price ELSE nullif(i.low_price, 0) END) AS low_price,
  CASE WHEN i.date IS NULL THEN b.close_price ELSE i.close_price END AS close_price, coalesce(b.volume, 0) AS volume,
  CASE WHEN b.date IS NULL THEN i.change_percent ELSE b.change_percent END AS change_percent
  FROM base b FULL JOIN inc i ON b.date = i.date""",
    "bar_insert_counts": f"""{_G}{_HALVES} SELECT count(*) FILTER (WHERE date NOT IN (SELECT date FROM base)) AS inserted,
  count(*) FILTER (WHERE date IN (SELECT date FROM base)) AS skipped FROM inc""",
    "bar_insert_if_absent": f"{_G}{_HALVES} SELECT * FROM base UNION ALL SELECT * FROM inc WHERE date NOT IN (SELECT date FROM base)",
    "dollar_synth_upsert": f"""WITH {DOLLAR_SQL}, n AS (SELECT *, {_DAY} AS k FROM dollar),
tick AS (SELECT a.date, a.close_price AS price, coalesce(p.close_price, a.close_price) AS prev FROM n a LEFT JOIN n p ON p.date + 1 = a.date WHERE a.k % 2 = 1 OR a.k % 3 = 0),
base AS (SELECT * FROM n WHERE k % 2 = 0)
SELECT coalesce(b.date, t.date) AS date, coalesce(t.prev, b.open_price) AS open_price, greatest(b.high_price, t.price, t.prev) AS high_price,
  least(b.low_price, t.price, t.prev) AS low_price, coalesce(t.price, b.close_price) AS close_price, 0 AS volume,
  CASE WHEN t.date IS NULL THEN 0.0 ELSE (t.price - t.prev) / t.prev * 100 END AS change_percent FROM base b FULL JOIN tick t ON b.date = t.date""",
    "sma_bollinger": f"""{_S}, w AS (SELECT *, count(close_price) {_LINE.format(n=19)} AS c, avg(close_price) {_LINE.format(n=19)} AS m, stddev_pop(close_price) {_LINE.format(n=19)} AS s FROM bars)
SELECT {_BARS}, CASE WHEN c = 20 THEN round(m, 4) END AS sma, CASE WHEN c = 20 THEN round(m + 2 * s, 4) END AS upper, CASE WHEN c = 20 THEN round(m - 2 * s, 4) END AS lower FROM w""",
    "rsi": f"""{_S}, v AS (SELECT *, close_price - lag(close_price) OVER (PARTITION BY series ORDER BY date) AS move FROM bars),
w AS (SELECT *, count(move) {_LINE.format(n=13)} AS c, sum(CASE WHEN move > 0 THEN move ELSE 0.0 END) {_LINE.format(n=13)} AS g, sum(CASE WHEN move < 0 THEN -move ELSE 0.0 END) {_LINE.format(n=13)} AS l FROM v)
SELECT {_BARS}, CASE WHEN c = 14 THEN round(CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END, 4) END AS rsi FROM w""",
    "macd": f"""{_S.replace("WITH", "WITH RECURSIVE", 1)}, r AS (SELECT series, date, close_price, row_number() OVER (PARTITION BY series ORDER BY date) AS rn FROM bars),
e AS (SELECT series, rn, date, close_price AS f, close_price AS l FROM r WHERE rn = 1
  UNION ALL SELECT r.series, r.rn, r.date, e.f * (1 - 2.0::DOUBLE / 13) + r.close_price * (2.0::DOUBLE / 13), e.l * (1 - 2.0::DOUBLE / 27) + r.close_price * (2.0::DOUBLE / 27) FROM e JOIN r ON r.series = e.series AND r.rn = e.rn + 1)
SELECT series, date, round(f - l, 4) AS macd FROM e""",
    "support_resistance": f"{_S} SELECT *, min(low_price) {_LINE.format(n=19)} AS support, max(high_price) {_LINE.format(n=19)} AS resistance FROM bars",
    "log_volatility": f"""{_S}, v AS (SELECT *, ln(close_price) - ln(lag(close_price) OVER (PARTITION BY series ORDER BY date)) AS r FROM bars)
SELECT {_BARS}, round(stddev_samp(r) {_LINE.format(n=19)}, 8) AS log_vol FROM v""",
    "trend_line": f"{_G}, v AS (SELECT close_price AS y, CAST(date - (SELECT min(date) FROM gold) AS DOUBLE) AS x FROM gold) SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM v",
    "outlier_filter": f"{_G}, s AS (SELECT avg(close_price) AS m, stddev_pop(close_price) AS s FROM gold) SELECT date, close_price AS price FROM gold, s WHERE s.s = 0 OR abs(close_price - m) <= 1.5 * s.s",
}
