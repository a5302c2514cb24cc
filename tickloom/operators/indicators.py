"""Technical indicators. They go beyond the running code that the engine stands in for, which only describes them.

Rolling indicators take bars of one or more series, with the series' column. Rows of a series are numbered and dealt to blocks, each
with copies of the few rows before it that a window looks back to, so no series meets in one task, however long or dense
it is (``operators.series``). Bars without a date are left out; bars of one date follow each other in no defined order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickloom.operators.series import in_blocks

#: Days of a time slice in which rows are numbered, and rows of a block.
SLICE_DAYS, BLOCK_ROWS = 365, 4_096


def _rolling(bars: DataFrame, series: str, back: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """bars with columns made over a line of each series that sees ``back`` rows before each of its own."""
    blocks = in_blocks(bars, "date", SLICE_DAYS, max(BLOCK_ROWS, back), back, (series,))
    line = Window.partitionBy(series, "__block").orderBy("__position")
    new = columns(line)
    return blocks.withColumns(new).where("__own").select(*(c for c in bars.columns if c not in new), *new)


def bollinger(bars: DataFrame, series: str, days: int = 20, width: float = 2.0) -> DataFrame:
    """Moving average and bands of the close; NULL before ``days`` bars."""

    def columns(line):
        over = line.rowsBetween(1 - days, 0)
        full = F.count("close_price").over(over) == days
        mean, sd = F.avg("close_price").over(over), F.stddev_pop("close_price").over(over)
        return {name: F.when(full, value) for name, value in (("sma", mean), ("upper", mean + width * sd), ("lower", mean - width * sd))}

    return _rolling(bars, series, days - 1, columns)


def rsi(bars: DataFrame, series: str, days: int = 14) -> DataFrame:
    """Relative strength from simple averages of gains and losses; 100 without losses, NULL before ``days`` changes."""
    moved = _rolling(bars, series, 1, lambda line: {"__move": F.col("close_price") - F.lag("close_price").over(line)})

    def columns(line):
        over = line.rowsBetween(1 - days, 0)
        gain = F.sum(F.greatest("__move", F.lit(0.0))).over(over)
        loss = F.sum(F.greatest(-F.col("__move"), F.lit(0.0))).over(over)
        value = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
        return {"rsi": F.when(F.count("__move").over(over) == days, value)}

    return _rolling(moved, series, days - 1, columns).drop("__move")


def macd(bars: DataFrame, series: str, fast: int = 12, slow: int = 26) -> DataFrame:
    """(series, date, macd): the difference of two exponential averages that start at the first close.

    An average is a sum of closes weighted by powers of 1 - w. Those of a block and of as many rows before it as a weight needs to
    fall below 2**-60 are summed as they come, scaled by the power of the block's first row. Bars without a close count as none.
    """
    back = math.ceil(60 * math.log(2) / -math.log1p(-2.0 / (max(fast, slow) + 1)))
    closes = bars.where(F.col("close_price").isNotNull()).select(series, "date", "close_price")
    blocks = in_blocks(closes, "date", SLICE_DAYS, back, back, (series,))
    step = F.col("__position") - F.greatest(F.col("__block") * back - back + 1, F.lit(1))
    upto = Window.partitionBy(series, "__block").orderBy("__position").rowsBetween(Window.unboundedPreceding, 0)

    def average(days: int) -> Column:
        keep = 1 - 2.0 / (days + 1)
        weight = F.when(F.col("__position") == 1, 1.0).otherwise(1 - keep)
        return F.sum(weight * F.col("close_price") * F.pow(F.lit(keep), -step)).over(upto) * F.pow(F.lit(keep), step)

    return blocks.withColumn("macd", average(fast) - average(slow)).where("__own").select(series, "date", "macd")


def support_resistance(bars: DataFrame, series: str, days: int = 20) -> DataFrame:
    """Lowest low and highest high of the last days; ``series.price_levels`` has levels of local extremes."""
    over = lambda line: line.rowsBetween(1 - days, 0)
    return _rolling(bars, series, days - 1, lambda line: {"support": F.min("low_price").over(over(line)), "resistance": F.max("high_price").over(over(line))})


def log_volatility(bars: DataFrame, series: str, days: int = 20) -> DataFrame:
    """Sample deviation of the daily log returns of the last days."""
    returns = _rolling(bars, series, 1, lambda line: {"__r": F.ln("close_price") - F.ln(F.lag("close_price").over(line))})
    return _rolling(returns, series, days - 1, lambda line: {"log_vol": F.stddev_samp("__r").over(line.rowsBetween(1 - days, 0))}).drop("__r")


def trend(bars: DataFrame) -> DataFrame:
    """Slope of the close per day and its value at the first day."""
    first = bars.agg(F.min("date").alias("d0"))
    rows = bars.crossJoin(F.broadcast(first)).withColumn("x", F.date_diff("date", "d0").cast("double"))
    return rows.agg(F.regr_slope("close_price", "x").alias("slope"), F.regr_intercept("close_price", "x").alias("intercept"))


def correlation(pairs: DataFrame) -> DataFrame:
    """Correlation of gold and dollar over all common days."""
    return pairs.agg(F.corr("gold_price", "dollar_index").alias("correlation"), F.count("*").alias("n_days"))


def sentiment_band(score: Column, edge: float = 0.1) -> Column:
    return F.when(score > edge, "positive").when(score < -edge, "negative").otherwise("neutral")


#: Weights of the fused score.
FUSION = {"technical": 0.30, "fundamentals": 0.25, "sentiment": 0.25, "institutional": 0.20}


def fused_score(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", sum((F.col(k) * v for k, v in FUSION.items()), F.lit(0.0)))


def keyword_weights(texts: DataFrame, top: int = 5) -> DataFrame:
    """texts(id, title): the words of each title with the largest tf * ln(N / df), ties in word order."""
    words = texts.select("id", F.explode(F.array_remove(F.split(F.lower("title"), r"[^a-z0-9]+"), "")).alias("word"))
    tf = words.groupBy("id", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = texts.agg(F.count_distinct("id").alias("n"))
    rows = tf.join(df, "word").crossJoin(F.broadcast(n)).withColumn("weight", F.col("tf") * F.ln(F.col("n") / F.col("df")))
    best = Window.partitionBy("id").orderBy(F.desc("weight"), "word")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("id", "word", "weight", "rank")


def without_outliers(quotes: DataFrame, column: str = "price", z: float = 3.0) -> DataFrame:
    """Rows within z deviations of the mean; all of them where there is no spread."""
    stats = quotes.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    rows = quotes.crossJoin(F.broadcast(stats))
    return rows.where((F.col("_s") == 0) | (F.abs(F.col(column) - F.col("_m")) <= z * F.col("_s"))).drop("_m", "_s")
