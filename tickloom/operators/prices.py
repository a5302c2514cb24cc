"""Price-series operators: DataFrame in, DataFrame out, with the as-of date as a parameter.

A series has one row per date with open_price, high_price, low_price, close_price (double) and may have volume. Empty
series give empty results unless an operator says otherwise; NULL prices never win an extreme.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import distance_from_high, falsy_coalesce, market_rule, market_status, pct_change, present
from tickloom.operators.series import carry_forward

#: Fixed values of an empty year: its start price and the date reported for its low.
DEFAULT_START, DEFAULT_MIN_DATE = 2633.0, "2025-01-02"


def _earliest(value) -> object:
    """Order key for a maximum whose ties go to the earliest date."""
    return F.struct(value, -F.unix_date("date"))


def stats_ytd(bars: DataFrame, anchor: str, quote: float | None = None, as_of: str | None = None) -> DataFrame:
    """Year-to-date statistics: one row; none without a bar and a quote.

    current is the quote or the latest close; start is the first open on or after the anchor (close where it is missing).
    Highs and lows skip NULL and zero and include the current price, whose date is ``as_of`` (the last date if None) where
    it is the extreme; other ties go to the earliest date.
    """
    since = F.col("date") >= F.lit(anchor).cast("date")
    high, low = present(F.when(since, F.col("high_price"))), present(F.when(since, F.col("low_price")))
    start = falsy_coalesce(F.col("open_price"), F.col("close_price"))
    one = bars.agg(
        F.max("date").alias("last_date"),
        F.max_by("close_price", "date").alias("last_close"),
        F.min_by(F.when(since, start), F.when(since, F.col("date"))).alias("start_price"),
        F.max(high).alias("high"),
        F.max_by("date", F.when(high.isNotNull(), _earliest(high))).alias("high_date"),
        F.min(low).alias("low"),
        F.min_by("date", F.when(low.isNotNull(), F.struct(low, F.unix_date("date")))).alias("low_date"),
    )
    current = F.coalesce(F.lit(quote).cast("double"), F.col("last_close"))
    today = F.coalesce(F.lit(as_of).cast("date"), F.col("last_date"))
    out = one.withColumns({"current_price": current, "today": today, "start_price": F.coalesce("start_price", F.lit(DEFAULT_START))}).where(
        F.col("current_price").isNotNull()
    )
    out = out.withColumns(
        {
            "max_price": F.greatest("high", "current_price"),
            "min_price": F.when(F.col("low").isNull() & F.col("high").isNull(), F.col("start_price")).otherwise(F.least("low", "current_price")),
            "ytd_return": (F.col("current_price") - F.col("start_price")) / F.col("start_price") * 100,
        }
    )
    return out.select(
        "current_price",
        "start_price",
        "ytd_return",
        "max_price",
        "min_price",
        F.when(F.col("max_price") == F.col("current_price"), F.col("today")).otherwise(F.col("high_date")).cast("string").alias("max_date"),
        F.when(F.col("low").isNull() & F.col("high").isNull(), F.lit(DEFAULT_MIN_DATE))
        .when(F.col("min_price") == F.col("current_price"), F.col("today").cast("string"))
        .otherwise(F.col("low_date").cast("string"))
        .alias("min_date"),
        F.when(F.col("min_price") > 0, (F.col("max_price") - F.col("min_price")) / F.col("min_price") * 100).otherwise(F.lit(0.0)).alias("volatility"),
    )


def previous_close(bars: DataFrame) -> DataFrame:
    """The latest bar with the close before it; a single bar is its own predecessor with change 0."""
    pair = bars.orderBy(F.desc("date")).limit(2)
    both = pair.agg(
        F.max("date").alias("date"),
        F.max_by("close_price", "date").alias("close_price"),
        F.min_by("close_price", "date").alias("prev_close"),
    ).where(F.col("date").isNotNull())
    return both.withColumn("change", pct_change(F.col("close_price"), F.col("prev_close")))


def with_status(stats: DataFrame, previous: DataFrame) -> DataFrame:
    """Statistics with the rule-based market status; both inputs hold one row at most."""
    joined = stats.crossJoin(F.broadcast(previous.select("prev_close")))
    daily = pct_change(F.col("current_price"), F.col("prev_close"))
    rule = market_rule(daily, F.col("ytd_return"), distance_from_high(F.col("current_price"), F.col("max_price")))
    return joined.withColumns({"market_status": market_status(rule, 0), "market_status_desc": market_status(rule, 1)}).drop("prev_close")


def date_range(bars: DataFrame, start: str | None = None, end: str | None = None, latest: int | None = None) -> DataFrame:
    """date (text), price (close) and volume of a closed range, ascending; ``latest`` keeps that many last days."""
    rows = bars
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    if latest is not None:
        rows = rows.orderBy(F.desc("date")).limit(latest)
    return rows.select(F.col("date").cast("string").alias("date"), F.col("close_price").alias("price"), F.coalesce("volume", F.lit(0)).alias("volume")).orderBy("date")


def latest_bar(bars: DataFrame) -> DataFrame:
    return bars.orderBy(F.desc("date")).limit(1)


def first_bar_since(bars: DataFrame, anchor: str) -> DataFrame:
    """The first bar on or after the anchor."""
    return bars.where(F.col("date") >= F.lit(anchor).cast("date")).orderBy("date").limit(1)


def monthly_rollup(bars: DataFrame, anchor: str | None = None) -> DataFrame:
    """Per month: first and last close, extremes (close where high or low is missing), change in percent."""
    rows = bars if anchor is None else bars.where(F.col("date") >= F.lit(anchor).cast("date"))
    out = rows.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.min_by("close_price", "date").alias("open"),
        F.max_by("close_price", "date").alias("close"),
        F.min(falsy_coalesce(F.col("low_price"), F.col("close_price"))).alias("low"),
        F.max(falsy_coalesce(F.col("high_price"), F.col("close_price"))).alias("high"),
    )
    return out.withColumn("change", pct_change(F.col("close"), F.col("open")))


def monthly_rollup_latest(bars: DataFrame, months: int) -> DataFrame:
    """The older rollup: of the latest months * 30 bars, newest month first; open is the newest bar's open (close where it is
    missing) and close the oldest bar's close."""
    rows = bars.orderBy(F.desc("date")).limit(months * 30)
    out = rows.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.max_by(falsy_coalesce(F.col("open_price"), F.col("close_price")), "date").alias("open"),
        F.min_by("close_price", "date").alias("close"),
    )
    return out.withColumn("change", pct_change(F.col("close"), F.col("open"))).orderBy(F.desc("month")).limit(months)


def align(left: DataFrame, right: DataFrame, latest: int | None = None) -> DataFrame:
    """Days that both series have: date, gold_price, dollar_index; ``latest`` takes that many last days of each first."""
    if latest is not None:
        left, right = (x.orderBy(F.desc("date")).limit(latest) for x in (left, right))
    a = left.select("date", F.col("close_price").alias("gold_price"))
    return a.join(right.select("date", F.col("close_price").alias("dollar_index")), "date")


def period_extremes(bars: DataFrame, as_of: str) -> DataFrame:
    """Highest high and lowest low up to a day with their dates (the latest on ties) and the range in percent; 0 for no row."""
    rows = bars.where(F.col("date") <= F.lit(as_of).cast("date"))
    out = rows.agg(
        F.coalesce(F.max("high_price"), F.lit(0.0)).alias("period_high"),
        F.max_by("date", F.when(F.col("high_price").isNotNull(), F.struct("high_price", "date"))).alias("period_high_date"),
        F.coalesce(F.min("low_price"), F.lit(0.0)).alias("period_low"),
        F.min_by("date", F.when(F.col("low_price").isNotNull(), F.struct("low_price", -F.unix_date("date")))).alias("period_low_date"),
    )
    spread = F.when(F.col("period_low") > 0, (F.col("period_high") - F.col("period_low")) / F.nullif("period_low", F.lit(0.0)) * 100)
    return out.withColumn("volatility_range", F.coalesce(spread, F.lit(0.0)))


def close_context(bars: DataFrame, anchor: str | None) -> DataFrame:
    """First and last close since the anchor (all bars for None), extreme closes, the return and the range in percent of the low."""
    rows = bars if anchor is None else bars.where(F.col("date") >= F.lit(anchor).cast("date"))
    key = F.when(F.col("close_price").isNotNull(), _earliest(F.col("close_price")))
    low_key = F.when(F.col("close_price").isNotNull(), F.struct("close_price", F.unix_date("date")))
    out = rows.agg(
        F.min_by("close_price", "date").alias("start_price"),
        F.max_by("close_price", "date").alias("current_price"),
        F.max("close_price").alias("max_price"),
        F.min("close_price").alias("min_price"),
        F.max_by("date", key).alias("max_date"),
        F.min_by("date", low_key).alias("min_date"),
    ).where(F.col("current_price").isNotNull())
    return out.withColumns({"return_pct": pct_change(F.col("current_price"), F.col("start_price")), "volatility": pct_change(F.col("max_price"), F.col("min_price"))})


def factor_context(bars: DataFrame, anchor: str) -> DataFrame:
    """Latest close with its daily change and its change since the first close on or after the anchor."""
    return previous_close(bars).crossJoin(F.broadcast(close_context(bars, anchor).select("start_price"))).withColumn("ytd_change", pct_change(F.col("close_price"), F.col("start_price")))


def trading_days(bars: DataFrame) -> DataFrame:
    """Monday to Friday."""
    return bars.where(F.weekday("date") < 5)


def axis_domain(bars: DataFrame, column: str = "close_price", pad: float = 0.1) -> DataFrame:
    """One row: the range of a column, padded on both sides by a share of its width and not below 0; 0 to 100 for no value."""
    value = F.when(~F.isnan(column), F.col(column))
    out = bars.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) * pad
    return out.select(F.coalesce(F.greatest(F.lit(0.0), F.col("lo") - width), F.lit(0.0)).alias("low"), F.coalesce(F.col("hi") + width, F.lit(100.0)).alias("high"))


def overlay_daily(daily: DataFrame, as_of: str, price: float, end: str | None = None) -> DataFrame:
    """A daily series (date text, price, volume) with the quote of a day in place of its row or behind the last.

    Nothing changes where the series is empty or its range ends before that day.
    """
    if end is not None and end < as_of:
        return daily
    quote = daily.limit(1).select(F.lit(as_of).alias("date"), F.lit(price).cast("double").alias("price"), F.lit(0).alias("volume"))
    return daily.where(F.col("date") != as_of).unionByName(quote)


def overlay_aligned(pairs: DataFrame, as_of: str, gold: float | None = None, dollar: float | None = None) -> DataFrame:
    """An aligned series with a day's quotes; a missing quote of either carries its last value forward, and without both
    nothing changes."""
    if gold is None and dollar is None:
        return pairs
    last = pairs.agg(F.max_by("gold_price", "date").alias("last_gold"), F.max_by("dollar_index", "date").alias("last_dollar"), F.count("*").alias("n")).where("n > 0")
    value = lambda given, carried: F.coalesce(F.lit(given).cast("double"), carried)
    quote = last.select(F.lit(as_of).cast("date").alias("date"), value(gold, "last_gold").alias("gold_price"), value(dollar, "last_dollar").alias("dollar_index"))
    return pairs.where(F.col("date") != F.lit(as_of).cast("date")).unionByName(quote)


def overlay_quotes(pairs: DataFrame, quotes: DataFrame, width: int = 365) -> DataFrame:
    """An aligned series with the quotes(ts, gold, dollar) of many days; the last value of each of a day holds.

    A day that lacks a quote of one side keeps its stored value, else it takes the last one before it, stored or quoted. Quoted days
    for which a side has no value at all are left out; so is a quote without a time. Laying the same quotes over the result changes
    nothing. ``width`` is the days of a time slice (``operators.series``).
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts")))
    days = quotes.where("ts IS NOT NULL").groupBy(F.to_date("ts").alias("__date")).agg(last("gold").alias("__gold"), last("dollar").alias("__dollar"))
    both = pairs.join(days, F.col("date") == F.col("__date"), "full_outer")
    both = both.select(
        F.coalesce("date", "__date").alias("date"),
        F.coalesce("__gold", "gold_price").alias("gold_price"),
        F.coalesce("__dollar", "dollar_index").alias("dollar_index"),
        F.col("__date").isNotNull().alias("__quoted"),
        F.struct("gold_price", "dollar_index").alias("__stored"),
    )
    carried = carry_forward(both, ["gold_price", "dollar_index"], "date", width)
    value = lambda c: F.when(F.col("__quoted"), F.col(c)).otherwise(F.col(f"__stored.{c}")).alias(c)
    whole = ~F.col("__quoted") | (F.col("gold_price").isNotNull() & F.col("dollar_index").isNotNull())
    return carried.where(whole).select("date", value("gold_price"), value("dollar_index"))


def resolve_quote(bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """The best realtime quote, by ascending priority, or else the latest close with its change to the day before.

    quotes(priority, price, change_pct); a NULL price is no quote. No row without a quote and a bar.
    """
    stored = previous_close(bars).select(F.lit(2**31 - 1).alias("priority"), F.col("close_price").alias("price"), F.col("change").alias("change_pct"))
    live = quotes.where(F.col("price").isNotNull()).select("priority", "price", "change_pct")
    return live.unionByName(stored).orderBy("priority").limit(1)
