"""Report queries on the test tables with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import documents as doc
from tickloom.functions import labels
from tickloom.operators import prices as op
from tickloom.operators import reports as rep
from tickloom.plans.prices import ANCHOR, AS_OF, QUOTE
from tickloom.sources.views import FACTORS_SQL, GOLD_SQL, INSTITUTIONS_SQL, NEWS_SQL, factors, gold_bars, institutions, news_items, table


def ticks(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("value").alias("price"))


def institution_views(spark, sf_dir):
    return institutions(spark, sf_dir).withColumn("reasoning", F.repeat("logo", 20))


def targets(spark, sf_dir):
    rows = institutions(spark, sf_dir).select(F.col("institution_name").alias("institution"), F.col("target_price").alias("target"), F.lit("high").alias("probability"), "timeframe")
    return rep.with_current_target(rows, QUOTE)


def chart_labels(spark, sf_dir):
    bars = gold_bars(spark, sf_dir)
    change = op.pct_change(F.col("close_price"), F.col("open_price"))
    return bars.select("date", labels.short_day(F.col("date")).alias("short"), labels.long_day(F.col("date")).alias("long"), labels.dollars(F.col("close_price")).alias("price"), labels.status_color(F.when(change > 0, "上涨").when(change < 0, "下跌")).alias("color"))


def impact_labels(spark, sf_dir):
    rows = factors(spark, sf_dir).select(labels.impact_label(labels.checked(F.col("impact"), ("high", "medium", "low"))).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def decorated_documents(spark, sf_dir):
    """Documents around each event's properties: defaults for missing fields, the quote put in, and metadata."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint, price double, points array<string>").alias("doc"))
    full = doc.with_defaults(F.col("doc"), {"k": F.lit(-1).cast("long"), "price": F.lit(5067.0)})
    shown = doc.with_metadata(doc.override(full, "price", F.when(F.col("event_id") % 2 == 0, F.lit(QUOTE))), cached=F.col("event_id") % 3 == 0, source="events", generated_at=F.lit("2024-01-30"))
    out = rows.select("event_id", shown.alias("d"), doc.is_filled(F.col("doc")["points"]).alias("filled"))
    return out.select("event_id", "d.k", "d.price", "d.metadata.cached", "d.metadata.source", "filled")


QUERIES = {
    "trailing_days": lambda spark, sf_dir: rep.trailing_days(gold_bars(spark, sf_dir), AS_OF, 30),
    "price_context_lines": lambda spark, sf_dir: rep.price_lines(gold_bars(spark, sf_dir)),
    "news_time_lines": lambda spark, sf_dir: rep.news_lines(news_items(spark, sf_dir)),
    "news_sentiment_lines": lambda spark, sf_dir: rep.sentiment_lines(news_items(spark, sf_dir)),
    "factor_context_lines": lambda spark, sf_dir: rep.factor_lines(factors(spark, sf_dir)),
    "institution_context_lines": lambda spark, sf_dir: rep.institution_lines(institution_views(spark, sf_dir)),
    "running_extremes": lambda spark, sf_dir: rep.running_extremes(ticks(spark, sf_dir)),
    "extended_stats": lambda spark, sf_dir: rep.extended_stats(gold_bars(spark, sf_dir), ANCHOR),
    "targets_with_current": targets,
    "chart_labels": chart_labels,
    "impact_labels": impact_labels,
    "decorated_documents": decorated_documents,
}

_G, _N, _F, _I = (f"WITH {x}" for x in (GOLD_SQL, NEWS_SQL, FACTORS_SQL, INSTITUTIONS_SQL))
_DAY_SO_FAR = "OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts)"

ORACLE = {
    "trailing_days": f"{_G} SELECT * FROM gold WHERE date >= DATE '{AS_OF}' - 30 ORDER BY date DESC LIMIT 30",
    "price_context_lines": f"{_G} SELECT string_agg('- ' || date || ': ' || format('${{:.2f}}', close_price), chr(10) ORDER BY date DESC) AS context FROM (SELECT * FROM gold ORDER BY date DESC LIMIT 10)",
    "news_time_lines": f"{_N} SELECT string_agg('- [' || strftime(published_at, '%Y-%m-%d %H:%M') || '] ' || title, chr(10) ORDER BY published_at DESC, id) AS context FROM (SELECT * FROM news ORDER BY published_at DESC, id LIMIT 10)",
    "news_sentiment_lines": f"{_N} SELECT string_agg('- [' || sentiment || '] ' || title, chr(10) ORDER BY published_at DESC, id) AS context FROM (SELECT * FROM news ORDER BY published_at DESC, id LIMIT 10)",
    "factor_context_lines": f"{_F} SELECT string_agg('- ' || title || ': ' || description || ' (影响强度: ' || impact || ')', chr(10) ORDER BY id) AS context FROM (SELECT * FROM factors ORDER BY id LIMIT 8)",
    "institution_context_lines": f"""{_I} SELECT string_agg('- ' || institution_name || ': 目标价$' || format('{{:.2f}}', target_price) || ', 评级: ' || rating || ', 时间框架: ' || timeframe || ', 理由: '
  || substring(repeat(logo, 20), 1, 100) || '...', chr(10) ORDER BY id) AS context FROM (SELECT * FROM institutions ORDER BY id LIMIT 6)""",
    "running_extremes": f"SELECT event_id, ts, value AS price, max(value) {_DAY_SO_FAR} AS day_high, min(value) {_DAY_SO_FAR} AS day_low FROM events",
    "extended_stats": f"""{_G}, l AS (SELECT *, lag(close_price) OVER (ORDER BY date) AS prev_close FROM gold ORDER BY date DESC LIMIT 1),
y AS (SELECT max(nullif(high_price, 0)) AS hi, min(nullif(low_price, 0)) AS lo, arg_min(coalesce(nullif(open_price, 0), close_price), date) AS start FROM gold WHERE date >= DATE '{ANCHOR}'),
j AS (SELECT *, greatest(hi, close_price) AS ytd_high, least(lo, close_price) AS ytd_low FROM l, y)
SELECT close_price AS current_price, open_price, high_price, low_price, volume, prev_close, close_price - prev_close AS change, (close_price - prev_close) / prev_close * 100 AS change_percent,
  ytd_high, ytd_low, (close_price - start) / start * 100 AS ytd_change, (ytd_high - ytd_low) / ytd_low * 100 AS volatility_range FROM j""",
    "targets_with_current": f"{_I} SELECT institution_name AS institution, target_price AS target, 'high' AS probability, timeframe FROM institutions UNION ALL SELECT '当前价格', {QUOTE}, '-', '实时'",
    "chart_labels": f"""{_G} SELECT date, month(date) || '/' || day(date) AS short, year(date) || '/' || month(date) || '/' || day(date) AS long,
  format('${{:,.2f}}', close_price) AS price, CASE WHEN close_price > open_price THEN 'green' WHEN close_price < open_price THEN 'red' ELSE 'gray' END AS color FROM gold""",
    "impact_labels": f"{_F} SELECT CASE impact WHEN 'high' THEN '高影响' WHEN 'low' THEN '低影响' ELSE '中影响' END AS label, count(*) AS n FROM factors GROUP BY 1",
    "decorated_documents": f"""SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, CASE WHEN event_id % 2 = 0 THEN {QUOTE}::DOUBLE ELSE 5067.0::DOUBLE END AS price,
  event_id % 3 = 0 AS cached, 'events' AS source, false AS filled FROM events""",
}
