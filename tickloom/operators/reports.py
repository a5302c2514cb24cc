"""Context lines, running extremes and dashboard rows of market data.

Lines come as one row with one text, newest or smallest id first, so many at most; without rows it is the text for none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.prices import latest_bar, previous_close, stats_ytd

#: The texts for no rows.
NO_DATA, NO_NEWS, NO_PRICES = "暂无数据", "暂无新闻数据", "暂无价格数据"


def joined_lines(df: DataFrame, line: Column, order: list[Column], most: int, empty: str = NO_DATA) -> DataFrame:
    """The first rows by ``order``, which must be total, as one text; the window holds ``most`` rows."""
    rows = df.orderBy(*order).limit(most)
    rows = rows.select(F.row_number().over(Window.orderBy(*order)).alias("k"), F.coalesce(line, F.lit("")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    return rows.agg(lines.alias("lines")).select(F.when(F.size("lines") > 0, F.array_join("lines", "\n")).otherwise(F.lit(empty)).alias("context"))


def price_lines(bars: DataFrame, most: int = 10) -> DataFrame:
    return joined_lines(bars, F.concat(F.lit("- "), F.col("date").cast("string"), F.lit(": "), F.format_string("$%.2f", "close_price")), [F.desc("date")], most, NO_PRICES)


def news_lines(news: DataFrame, most: int = 10, stamp: str = "published_at") -> DataFrame:
    line = F.concat(F.lit("- ["), F.date_format(stamp, "yyyy-MM-dd HH:mm"), F.lit("] "), F.col("title"))
    return joined_lines(news, line, [F.desc(stamp), F.col("id")], most, NO_NEWS)


def sentiment_lines(news: DataFrame, most: int = 10, stamp: str = "published_at") -> DataFrame:
    line = F.concat(F.lit("- ["), F.coalesce("sentiment", F.lit("neutral")), F.lit("] "), F.col("title"))
    return joined_lines(news, line, [F.desc(stamp), F.col("id")], most)


def factor_lines(factors: DataFrame, most: int = 8) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat(F.lit("- "), text("title"), F.lit(": "), text("description"), F.lit(" (影响强度: "), F.coalesce("impact", F.lit("中")), F.lit(")"))
    return joined_lines(factors, line, [F.col("id")], most)


def institution_lines(institutions: DataFrame, most: int = 6, reason: str = "reasoning", cap: int = 100) -> DataFrame:
    """Name, target, rating, timeframe and the first characters of the reasoning."""
    text = lambda c: F.coalesce(c, F.lit("N/A"))
    line = F.concat(
        F.lit("- "), F.coalesce("institution_name", F.lit("")),
        F.lit(": 目标价$"), text(F.format_string("%.2f", "target_price")),
        F.lit(", 评级: "), text("rating"),
        F.lit(", 时间框架: "), text("timeframe"),
        F.lit(", 理由: "), F.substring(text(reason), 1, cap), F.lit("..."),
    )
    return joined_lines(institutions, line, [F.col("id")], most)


def trailing_days(bars: DataFrame, as_of: str, days: int = 10) -> DataFrame:
    """The bars of the last days before ``as_of`` and after, newest first, so many rows at most."""
    return bars.where(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)).orderBy(F.desc("date")).limit(days)


def running_extremes(ticks: DataFrame) -> DataFrame:
    """ticks(ts, price, ...) with day_high and day_low: the extremes of the day so far, ticks of the same time included.

    A NULL price changes nothing; a tick with a NULL time stays and gets NULLs. A day may hold very many ticks, so windows run inside minutes; the extremes of the minutes before come from a window
    over at most 1440 sums of a day.
    """
    base = ticks.drop("day_high", "day_low")
    t = base.withColumns({"_tick_day": F.to_date("ts"), "_tick_minute": F.date_trunc("minute", "ts")})
    minutes = t.groupBy("_tick_day", "_tick_minute").agg(F.max("price").alias("hi"), F.min("price").alias("lo"))
    before = Window.partitionBy("_tick_day").orderBy("_tick_minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.select("_tick_minute", F.max("hi").over(before).alias("_high_before"), F.min("lo").over(before).alias("_low_before"))
    inside = Window.partitionBy("_tick_minute").orderBy("ts")
    rows = t.withColumns({"_high_inside": F.max("price").over(inside), "_low_inside": F.min("price").over(inside)}).join(minutes, "_tick_minute", "left")
    timed = lambda c: F.when(F.col("ts").isNotNull(), c)
    return rows.select(*base.columns, timed(F.greatest("_high_inside", "_high_before")).alias("day_high"), timed(F.least("_low_inside", "_low_before")).alias("day_low"))


def extended_stats(bars: DataFrame, anchor: str) -> DataFrame:
    """The latest bar with the close before it, its change, and the year's extremes and change; one row at most."""
    last = latest_bar(bars).select(F.col("close_price").alias("current_price"), "open_price", "high_price", "low_price", F.coalesce("volume", F.lit(0)).alias("volume"))
    prev = previous_close(bars).select("prev_close", (F.col("close_price") - F.col("prev_close")).alias("change"), F.col("change").alias("change_percent"))
    year = stats_ytd(bars, anchor).select(F.col("max_price").alias("ytd_high"), F.col("min_price").alias("ytd_low"), F.col("ytd_return").alias("ytd_change"), F.col("volatility").alias("volatility_range"))
    return last.crossJoin(F.broadcast(prev)).crossJoin(F.broadcast(year))


def with_current_target(institutions: DataFrame, price: float) -> DataFrame:
    """(institution, target, probability, timeframe) with the current price as a last row of its own."""
    rows = institutions.select("institution", "target", "probability", "timeframe")
    now = institutions.sparkSession.createDataFrame([("当前价格", float(price), "-", "实时")], "institution string, target double, probability string, timeframe string")
    return rows.unionByName(now)
