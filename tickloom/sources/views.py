"""Logical market inputs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gold_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from orders: first and last price of the day by order key, extremes and count."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(
            F.min_by(price, key).alias("open_price"),
            F.max(price).alias("high_price"),
            F.min(price).alias("low_price"),
            F.max_by(price, key).alias("close_price"),
            F.count("*").cast("int").alias("volume"),
        )
    )


def dollar_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second daily series from lineitem; the struct key is a total order."""
    price = F.col("l_extendedprice")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"))
        .agg(
            F.min_by(price, key).alias("open_price"),
            F.max(price).alias("high_price"),
            F.min(price).alias("low_price"),
            F.max_by(price, key).alias("close_price"),
        )
    )


#: The same two series for the SQL counterparts.
GOLD_SQL = """gold AS (
  SELECT CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open_price,
         max(o_totalprice) AS high_price, min(o_totalprice) AS low_price,
         arg_max(o_totalprice, o_orderkey) AS close_price, CAST(count(*) AS INTEGER) AS volume
  FROM orders GROUP BY 1)"""

DOLLAR_SQL = """ranked AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price,
         row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE)
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS up,
         row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE)
           ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS down
  FROM lineitem),
dollar AS (
  SELECT date, max(CASE WHEN up = 1 THEN price END) AS open_price, max(price) AS high_price,
         min(price) AS low_price, max(CASE WHEN down = 1 THEN price END) AS close_price
  FROM ranked GROUP BY date)"""


def series_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both daily series, with their name."""
    columns = ("date", "open_price", "high_price", "low_price", "close_price")
    both = (("gold", gold_bars), ("dollar", dollar_bars))
    gold, dollar = (bars(spark, sf_dir).select(F.lit(name).alias("series"), *columns) for name, bars in both)
    return gold.union(dollar)


SERIES_SQL = f"""{GOLD_SQL}, {DOLLAR_SQL}, bars AS (
  SELECT 'gold' AS series, date, open_price, high_price, low_price, close_price FROM gold
  UNION ALL SELECT 'dollar', date, open_price, high_price, low_price, close_price FROM dollar)"""


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A news feed from events."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("int").alias("id"),
        F.concat(kind, F.lit(" #"), F.col("event_id")).alias("title"),
        F.concat(F.lit("src"), F.get_json_object("props", "$.k").cast("int") % 5).alias("source"),
        F.col("ts").alias("published_at"),
        F.when(kind.isin("purchase", "signup"), "positive").when(kind == "error", "negative").otherwise("neutral").alias("sentiment"),
        F.col("props").alias("keywords"),
    )


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullish and bearish factors from part."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("id"),
        F.when(size % 2 == 0, "bullish").otherwise("bearish").alias("type"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("subtitle"),
        F.col("p_type").alias("description"),
        F.split("p_name", " ").alias("details"),
        F.when(size >= 34, "high").when(size >= 17, "medium").otherwise("low").alias("impact"),
        F.lit(0.8).alias("confidence"),
    )


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions with ratings and target prices from supplier and nation."""
    target = F.col("s_acctbal")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").cast("int").alias("id"),
        F.col("s_name").alias("institution_name"),
        F.col("n_name").alias("logo"),
        F.when(target >= 5000, "bullish").when(target < 1000, "bearish").otherwise("neutral").alias("rating"),
        target.alias("target_price"),
        F.concat(F.lit("T"), F.col("s_suppkey") % 4).alias("timeframe"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price predictions from customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("id"),
        F.col("c_mktsegment").alias("prediction_type"),
        F.col("c_acctbal").alias("target_price"),
        ((F.col("c_custkey") % 100) / 100.0).alias("confidence"),
    )


NEWS_SQL = """news AS (
  SELECT CAST(event_id AS INTEGER) AS id, event_type || ' #' || event_id AS title,
         'src' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS source, ts AS published_at,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment,
         props AS keywords FROM events)"""

FACTORS_SQL = """factors AS (
  SELECT CAST(p_partkey AS INTEGER) AS id, CASE WHEN p_size % 2 = 0 THEN 'bullish' ELSE 'bearish' END AS type, p_name AS title,
         p_brand AS subtitle, p_type AS description, string_split(p_name, ' ') AS details,
         CASE WHEN p_size >= 34 THEN 'high' WHEN p_size >= 17 THEN 'medium' ELSE 'low' END AS impact, 0.8::DOUBLE AS confidence FROM part)"""

INSTITUTIONS_SQL = """institutions AS (
  SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS institution_name, n_name AS logo,
         CASE WHEN s_acctbal >= 5000 THEN 'bullish' WHEN s_acctbal < 1000 THEN 'bearish' ELSE 'neutral' END AS rating,
         s_acctbal AS target_price, 'T' || (s_suppkey % 4) AS timeframe FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

PREDICTIONS_SQL = """predictions AS (
  SELECT CAST(c_custkey AS INTEGER) AS id, c_mktsegment AS prediction_type, c_acctbal AS target_price,
         (c_custkey % 100) / 100.0::DOUBLE AS confidence FROM customer)"""
