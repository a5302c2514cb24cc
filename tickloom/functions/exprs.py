"""Scalar expressions shared by the operators; all of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    """NULL for NULL and for zero: prices use both for "missing"."""
    return F.nullif(value, F.lit(0.0))


def falsy_coalesce(value: Column, fallback: Column) -> Column:
    """``value``, or ``fallback`` where it is NULL or zero."""
    return F.coalesce(present(value), fallback)


def pct_change(value: Column, base: Column) -> Column:
    """Percent change; 0 where the base is NULL or zero."""
    return F.when(present(base).isNull(), F.lit(0.0)).otherwise((value - base) / present(base) * 100)


def distance_from_high(current: Column, high: Column) -> Column:
    """How far below the high, in percent of it; 0 without a high."""
    return F.when(present(high).isNull(), F.lit(0.0)).otherwise((high - current) / present(high) * 100)


#: Status and description by rule, first match wins.
STATUS = {
    "surge": ("强势上涨", "牛市延续"),
    "rise": ("上涨", "趋势向好"),
    "high": ("高位震荡", "整理蓄势"),
    "flat": ("震荡", "方向不明"),
    "pullback": ("回调", "正常调整"),
    "fall": ("下跌", "短期承压"),
    "wait": ("震荡", "观望为主"),
}


def market_rule(daily: Column, ytd: Column, below_high: Column) -> Column:
    """The key of STATUS for a day's change, the year's change and the distance from the high."""
    return (
        F.when((daily > 1) & (ytd > 20), "surge")
        .when((daily > 0) & (ytd > 10), "rise")
        .when(daily.between(-1, 1) & (below_high < 3), "high")
        .when(daily.between(-1, 1), "flat")
        .when((daily < 0) & (below_high < 5), "pullback")
        .when((daily < -1) | (ytd < 0), "fall")
        .otherwise("wait")
    )


def market_status(rule: Column, part: int) -> Column:
    """The label (part 0) or description (part 1) of a rule."""
    out = F.lit(None).cast("string")
    for key, words in STATUS.items():
        out = F.when(rule == key, words[part]).otherwise(out)
    return out


def safe_double(text: Column, default: float = 0.0, zero_is_missing: bool = False) -> Column:
    """Blank or malformed text gives the default, and with ``zero_is_missing`` the text 0.0 too."""
    given = F.nullif(F.trim(text), F.lit(""))
    if zero_is_missing:
        given = F.nullif(given, F.lit("0.0"))
    return F.coalesce(given.try_cast("double"), F.lit(default))


def first_keyword(text: Column, table: dict[str, str], default: str) -> Column:
    """The value of the first key, in declared order, that the text contains."""
    out = F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(F.contains(text, F.lit(key)), value).otherwise(out)
    return out
