"""Labels of dates, prices and enumerations for charts and cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of an impact; others get that of "medium".
IMPACT = {"high": "高影响", "medium": "中影响", "low": "低影响"}
#: Colours of a market status; others are gray.
STATUS_COLOR = {"强势上涨": "green", "上涨": "green", "下跌": "red", "回调": "amber", "高位震荡": "blue", "震荡": "blue"}


def looked_up(value: Column, table: dict[str, str], default: str) -> Column:
    """The entry of a fixed table; the default for NULL and unknown values."""
    out = F.lit(default)
    for key, label in table.items():
        out = F.when(value == key, label).otherwise(out)
    return out


def impact_label(impact: Column) -> Column:
    return looked_up(impact, IMPACT, IMPACT["medium"])


def status_color(status: Column) -> Column:
    return looked_up(status, STATUS_COLOR, "gray")


def short_day(date: Column) -> Column:
    """Month/day without leading zeros."""
    return F.date_format(date, "M/d")


def long_day(date: Column) -> Column:
    """Year/month/day without leading zeros."""
    return F.date_format(date, "yyyy/M/d")


def dollars(price: Column) -> Column:
    """$1,234.50, with the sign in front."""
    return F.concat(F.when(price < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(price), 2))


def thousands(price: Column) -> Column:
    """$4.5K."""
    return F.format_string("$%.1fK", price / 1000)


def signed(value: Column) -> Column:
    """+1.25 or -0.50."""
    return F.format_string("%+.2f", value)


def checked(value: Column, allowed: tuple[str, ...]) -> Column:
    """The value if it is allowed or NULL; any other fails the query."""
    wrong = F.raise_error(F.concat(F.lit("unknown value: "), value)).cast("string")
    return F.when(value.isNull() | value.isin(*allowed), value).otherwise(wrong)
