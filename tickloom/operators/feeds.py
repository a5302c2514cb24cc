"""News and opinion operators.

news(id, title, source, published_at, sentiment, ...), factors(id, type, title, impact, ...), institutions(id,
institution_name, rating, target_price, ...), predictions(id, ...). Ties of the recency order go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTIMENTS = ("positive", "neutral", "negative")


def check_limit(limit: int, most: int) -> int:
    """Limits outside 1..most are refused."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}, not {limit}")
    return limit


def filtered(df: DataFrame, **equal: str | None) -> DataFrame:
    """Equality on every column whose value is given."""
    tests = [F.col(k) == v for k, v in equal.items() if v]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def newest(df: DataFrame, by: str, limit: int, most: int = 100, offset: int = 0) -> DataFrame:
    """The newest rows by a column, ids ascending on ties; ``offset`` skips that many first."""
    rows = df.orderBy(F.desc(by), "id")
    return (rows.offset(offset) if offset else rows).limit(check_limit(limit, most))


def published_between(news: DataFrame, start: str, end: str) -> DataFrame:
    return news.where(F.col("published_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def recent(news: DataFrame, as_of: str, hours: int = 24, column: str = "published_at") -> DataFrame:
    """Rows of the last hours up to ``as_of``, both ends included."""
    end = F.lit(as_of).cast("timestamp")
    return news.where(F.col(column).between(end - F.make_dt_interval(hours=F.lit(hours)), end))


def recently_stored(news: DataFrame, as_of: str, hours: int = 24, cap: int = 20, column: str = "created_at") -> DataFrame:
    """The newest rows stored since so many hours before ``as_of``, open at the upper end, ``cap`` at most."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    return newest(news.where(F.col(column) >= since), column, cap)


def sentiment_counts(news: DataFrame) -> DataFrame:
    """One row with the number of items of each sentiment, 0 where there are none."""
    return news.agg(*(F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS))


def sentiment_shares(news: DataFrame) -> DataFrame:
    """Counts, total and shares, and the trend that the larger of positive and negative gives."""
    n = sentiment_counts(news).withColumn("total", sum((F.col(s) for s in SENTIMENTS), F.lit(0)))
    shares = {f"{s}_share": F.coalesce(F.try_divide(F.col(s).cast("double"), F.col("total")), F.lit(0.0)) for s in SENTIMENTS}
    trend = F.when(F.col("positive") > F.col("negative"), "positive").when(F.col("negative") > F.col("positive"), "negative").otherwise("neutral")
    return n.withColumns(shares | {"trend": trend})


def top_per_source(news: DataFrame, n: int = 5) -> DataFrame:
    line = Window.partitionBy("source").orderBy(F.desc("published_at"), "id")
    return news.withColumn("rn", F.row_number().over(line)).where(F.col("rn") <= n)


def context_lines(news: DataFrame, n: int = 15, empty: str = "no recent news") -> DataFrame:
    """One row: lines "[source] title" of the newest items, or the text for none."""
    rows = newest(news, "published_at", n)
    item = F.struct((-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("at"), "id", F.concat(F.lit("["), "source", F.lit("] "), "title").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"])
    return rows.agg(lines.alias("lines")).select(F.when(F.size("lines") > 0, F.array_join("lines", "\n")).otherwise(F.lit(empty)).alias("context"))


def numbered(titles: Column) -> Column:
    """"1. first", "2. second", ... of an array, one per line."""
    return F.array_join(F.transform(titles, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def by_keyword(news: DataFrame, word: str) -> DataFrame:
    return news.where(F.contains(F.lower("title"), F.lit(word.lower())))


def rating_counts(institutions: DataFrame) -> DataFrame:
    return institutions.agg(*(F.count_if(F.col("rating") == r).alias(r) for r in ("bullish", "bearish", "neutral")))


def names_by_rating(institutions: DataFrame, most: int | None = None) -> DataFrame:
    """Per rating the first words of all names, in order, joined by "、"; with ``most`` only that many of them, for a short line.

    ``n_names`` says how many there are.
    """
    named = institutions.select("rating", F.split("institution_name", " ")[0].alias("name"))
    if most is None:
        return named.groupBy("rating").agg(F.array_join(F.array_sort(F.collect_list("name")), "、").alias("names"), F.count("name").alias("n_names"))
    line = Window.partitionBy("rating").orderBy("name")
    counts = named.groupBy("rating").agg(F.count("name").alias("n_names"))
    first = named.where("name IS NOT NULL").withColumn("rn", F.row_number().over(line)).where(F.col("rn") <= most)
    lines = first.groupBy(F.col("rating").alias("r")).agg(F.array_join(F.array_sort(F.collect_list("name")), "、").alias("names"))
    return counts.join(lines, F.col("rating").eqNullSafe(F.col("r")), "left").select("rating", F.coalesce("names", F.lit("")).alias("names"), "n_names")


def target_range(institutions: DataFrame) -> DataFrame:
    return institutions.agg(F.min("target_price").alias("lowest"), F.max("target_price").alias("highest"), F.avg("target_price").alias("average"), F.mode("rating", True).alias("consensus"))


def target_consensus(views: DataFrame, weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group: the weighted target, how many views it is made of and their weight, the rating of most views and how many have it.

    weights(institution_name, weight). Weights are those of the views present: institutions without a positive weight, and views without a target,
    take no part in the target. Every view with a rating has one vote; a tie goes to the rating with more weight, then to
    the first in the alphabet. Counted per rating first, so a large group is a few rows.
    """
    known = weights.where("weight > 0").groupBy("institution_name").agg(F.max("weight").alias("weight"))
    rows = views.join(known, "institution_name", "left")
    counts = F.col("weight").isNotNull() & F.col("target_price").isNotNull()
    each = rows.groupBy(*by, "rating").agg(
        F.sum(F.when(counts, F.col("weight") * F.col("target_price"))).alias("value"),
        F.sum(F.when(counts, F.col("weight"))).alias("weight"),
        F.count_if(counts).alias("n"),
        F.count("*").alias("votes"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("heavy"),
    )
    ahead = F.when(F.col("rating").isNotNull(), F.struct((-F.col("votes")).alias("votes"), (-F.col("heavy")).alias("heavy"), "rating"))
    return each.groupBy(*by).agg(
        (F.sum("value") / F.sum("weight")).alias("weighted_target"),
        F.sum("n").alias("n_targets"),
        F.sum("weight").alias("total_weight"),
        F.min_by("rating", ahead).alias("rating"),
        F.min_by("votes", ahead).alias("votes"),
    )


def fresh_rows(df: DataFrame, as_of: int, ttl: int, least: int, take: int, stamp: str = "updated_at") -> DataFrame:
    """The first rows by id that are no older than ttl, if at least ``least`` are; else none. Stamps are epoch seconds."""
    fresh = df.where(F.lit(as_of) - F.col(stamp) <= ttl)
    gate = fresh.agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return fresh.orderBy("id").limit(take).crossJoin(F.broadcast(gate)).drop("n")


def high_impact(factors: DataFrame) -> DataFrame:
    return factors.groupBy("type").agg(F.count_if(F.col("impact") == "high").alias("high"), F.count("*").alias("total"))


#: Keyword to factor id, in the order in which they are looked for.
FACTOR_IDS = {"美联储": "fed-policy", "央行": "central-bank", "地缘": "geopolitical", "通胀": "inflation", "美元": "dollar"}


def advice_context(stats: DataFrame, bullish: DataFrame, bearish: DataFrame, institutions: DataFrame) -> DataFrame:
    """The four one-row inputs of an advice side by side; a missing one gives NULL columns."""
    out = stats
    for side in (bullish, bearish, institutions):
        out = out.join(F.broadcast(side.limit(1)), F.lit(True), "left")
    return out
