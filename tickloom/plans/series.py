"""Queries of the split series operators on the test tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import series as op
from tickloom.sources.views import DOLLAR_SQL, GOLD_SQL, SERIES_SQL, dollar_bars, gold_bars, series_bars, table

DAYS, HOURS = 180, 6 * 3600


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


def _kind(events, kind):
    return events.where(F.col("event_type") == kind)


def asof_previous_view(spark, sf_dir):
    """Per purchase the user's last view before it."""
    events = _events(spark, sf_dir)
    take = {"view_id": "event_id", "view_ts": "ts", "view_value": "value"}
    return op.as_of(_kind(events, "purchase"), _kind(events, "view"), "ts", take, HOURS, ("user_id",), strict=True, order=("event_id",)).drop("event_type", "value")


def asof_next_purchase(spark, sf_dir):
    """Per click the user's first purchase at or after it."""
    events = _events(spark, sf_dir)
    take = {"purchase_id": "event_id", "purchase_value": "value"}
    return op.as_of(_kind(events, "click"), _kind(events, "purchase"), "ts", take, HOURS, ("user_id",), direction="forward", order=("event_id",)).drop("event_type", "value")


def asof_dollar(spark, sf_dir):
    """Each gold day with the index of that day or the last one before, the one strictly before, and the next one's day."""
    gold, dollar = gold_bars(spark, sf_dir).select("date", F.col("close_price").alias("gold_price")), dollar_bars(spark, sf_dir)
    out = op.as_of(gold, dollar, "date", {"dollar_index": "close_price", "dollar_date": "date"}, DAYS)
    out = op.as_of(out, dollar, "date", {"dollar_before": "close_price"}, DAYS, strict=True)
    return op.as_of(out, dollar, "date", {"next_date": "date"}, DAYS, direction="forward")


def bars_with_previous(spark, sf_dir):
    """Every bar of both series with the closes around it and its change."""
    near = op.neighbours(series_bars(spark, sf_dir), ["close_price"], "date", DAYS, ("series",))
    change = F.when(F.col("prev_close_price") > 0, (F.col("close_price") - F.col("prev_close_price")) / F.col("prev_close_price") * 100)
    return near.select("series", "date", "close_price", "prev_close_price", "next_close_price", change.alias("change"))


def carried_values(spark, sf_dir):
    """Values of errors are missing; each takes the user's last one."""
    events = _events(spark, sf_dir).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return op.carry_forward(events, ["value"], "ts", HOURS, ("user_id",), ("event_id",))


def rolling_values(spark, sf_dir):
    """Per event the user's events and their cents in the last three days."""
    cents = F.round(F.col("value") * 100).cast("long")
    return op.rolling_sums(_events(spark, sf_dir), {"n": F.lit(1), "cents": cents}, "ts", 3 * 86_400, HOURS, ("user_id",)).drop("value")


def rolling_corr(spark, sf_dir):
    """Correlation of gold and dollar over 60 days, and of closes and volatility inside each series."""
    gold, dollar = gold_bars(spark, sf_dir), dollar_bars(spark, sf_dir)
    pairs = gold.select("date", F.col("close_price").alias("x")).join(dollar.select("date", F.col("close_price").alias("y")), "date").select(F.lit("gold-dollar").alias("series"), "date", "x", "y")
    own = series_bars(spark, sf_dir).select("series", "date", F.col("close_price").alias("x"), (F.col("high_price") - F.col("low_price")).alias("y"))
    out = op.rolling_correlation(pairs.union(own), "x", "y", "date", 59, DAYS, ("series",), least=3)
    return out.select("series", "date", "n_rows", F.round("correlation", 6).alias("correlation"))


def price_levels(spark, sf_dir):
    """Three levels a side of each series; extremes within 2 in 10,000 are one."""
    found = op.price_levels(series_bars(spark, sf_dir), DAYS, 0.0002, 3, ("series",))
    return found.select("series", "side", "rank", F.round("level", 4).alias("level"), "touches", "last_touch")


def row_positions(spark, sf_dir):
    return op.positions(_events(spark, sf_dir).select("event_id", "user_id", "ts"), "ts", HOURS, ("user_id",), ("event_id",))


QUERIES = {
    "asof_previous_view": asof_previous_view,
    "asof_next_purchase": asof_next_purchase,
    "asof_dollar": asof_dollar,
    "bars_with_previous": bars_with_previous,
    "carried_values": carried_values,
    "rolling_values": rolling_values,
    "rolling_corr": rolling_corr,
    "price_levels": price_levels,
    "row_positions": row_positions,
}

_SPAN = "(PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW)"
_ROLL = "(PARTITION BY series ORDER BY date RANGE BETWEEN INTERVAL 59 DAYS PRECEDING AND CURRENT ROW)"

ORACLE = {
    "asof_previous_view": """SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.ts AS view_ts, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts""",
    "asof_next_purchase": """SELECT c.event_id, c.user_id, c.ts, p.event_id AS purchase_id, p.value AS purchase_value
FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts <= p.ts""",
    "asof_dollar": f"""WITH {GOLD_SQL}, {DOLLAR_SQL} SELECT g.date, g.close_price AS gold_price, d.close_price AS dollar_index, d.date AS dollar_date, b.close_price AS dollar_before, n.date AS next_date
FROM gold g ASOF LEFT JOIN dollar d ON g.date >= d.date ASOF LEFT JOIN dollar b ON g.date > b.date ASOF LEFT JOIN dollar n ON g.date <= n.date""",
    "bars_with_previous": f"""WITH {SERIES_SQL}, w AS (SELECT series, date, close_price, lag(close_price) OVER l AS prev_close_price, lead(close_price) OVER l AS next_close_price FROM bars WINDOW l AS (PARTITION BY series ORDER BY date))
SELECT *, CASE WHEN prev_close_price > 0 THEN (close_price - prev_close_price) / prev_close_price * 100 END AS change FROM w""",
    "carried_values": """SELECT event_id, user_id, ts, event_type, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value FROM events WHERE ts IS NOT NULL""",
    "rolling_values": f"""SELECT event_id, user_id, ts, event_type, count(*) OVER {_SPAN} AS n, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER {_SPAN}, 0) AS BIGINT) AS cents FROM events WHERE ts IS NOT NULL""",
    "rolling_corr": f"""WITH {SERIES_SQL}, p AS (SELECT 'gold-dollar' AS series, date, g.close_price AS x, d.close_price AS y FROM gold g JOIN dollar d USING (date)
  UNION ALL SELECT series, date, close_price, high_price - low_price FROM bars)
SELECT series, date, count(*) OVER {_ROLL} AS n_rows, CASE WHEN count(*) OVER {_ROLL} >= 3 AND NOT isnan(corr(x, y) OVER {_ROLL}) THEN round(corr(x, y) OVER {_ROLL}, 6) END AS correlation FROM p""",
    "price_levels": f"""WITH {SERIES_SQL}, near AS (SELECT *, lag(low_price) OVER l AS pl, lead(low_price) OVER l AS nl, lag(high_price) OVER l AS ph, lead(high_price) OVER l AS nh FROM bars WINDOW l AS (PARTITION BY series ORDER BY date)),
ext AS (SELECT series, date, 'support' AS side, low_price AS price FROM near WHERE low_price < pl AND low_price < nl AND low_price > 0
  UNION ALL SELECT series, date, 'resistance', high_price FROM near WHERE high_price > ph AND high_price > nh AND high_price > 0),
gaps AS (SELECT *, CASE WHEN price <= lag(price) OVER l * (1 + 0.0002::DOUBLE) THEN 0 ELSE 1 END AS starts FROM ext WINDOW l AS (PARTITION BY series, side ORDER BY price, date)),
isles AS (SELECT *, sum(starts) OVER (PARTITION BY series, side ORDER BY price, date) AS isle FROM gaps),
lv AS (SELECT series, side, avg(price) AS level, count(*) AS touches, max(date) AS last_touch FROM isles GROUP BY series, side, isle),
cur AS (SELECT series, arg_max(close_price, date) AS c FROM bars GROUP BY series),
r AS (SELECT lv.*, row_number() OVER (PARTITION BY series, side ORDER BY touches DESC, last_touch DESC, level) AS rank FROM lv JOIN cur USING (series)
  WHERE CASE WHEN side = 'support' THEN level < c ELSE level > c END)
SELECT series, side, CAST(rank AS INTEGER) AS rank, round(level, 4) AS level, touches, last_touch FROM r WHERE rank <= 3""",
    "row_positions": "SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events WHERE ts IS NOT NULL",
}
