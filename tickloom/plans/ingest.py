"""Queries of ingest: routed rows, counters of a write, upserts of touched partitions, quotes laid over a stored series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import analyzers
from tickloom.functions import documents as doc
from tickloom.operators import ingest, prices
from tickloom.operators import upserts as up
from tickloom.plans.prices import _DAY, _HALVES, _halves
from tickloom.sources import payloads
from tickloom.sources.tables import read_partitions, read_statistics, scratch, upsert_partitions, write_partitions, write_statistics
from tickloom.sources.views import DOLLAR_SQL, FACTORS_SQL, GOLD_SQL, NEWS_SQL, dollar_bars, factors, gold_bars, news_items, table

BAR_SCHEMA = "date date, open_price double, high_price double, low_price double, close_price double, volume int, change_percent double"
SINCE = "1997-01-01"


def faulty_factors(spark, sf_dir):
    """Factors of which some have an unknown impact, no title, or a confidence out of range or missing."""
    k = F.col("id")
    return factors(spark, sf_dir).select(
        "id",
        F.when(k % 13 == 0, " ").when(k % 26 != 1, F.col("title")).alias("title"),
        F.when(k % 11 == 0, "severe").otherwise(F.col("impact")).alias("impact"),
        F.when(k % 17 == 0, 1.5).when(k % 19 != 0, F.col("confidence")).alias("confidence"),
    )


def factor_quarantine(spark, sf_dir):
    """Both outputs of one write, read back."""
    good, rejected = ingest.write_routed(faulty_factors(spark, sf_dir), ingest.factor_checks(), scratch(spark, "routed"))
    return good.withColumn("reason", F.lit("")).unionByName(rejected)


def ingest_counters(spark, sf_dir):
    """Counts that the write of new bars takes: some incoming bars come twice, some have no price."""
    base, new = _halves(gold_bars(spark, sf_dir))
    day = F.unix_date("date")
    new = new.union(new.where(day % 4 == 0)).withColumn("close_price", F.when(day % 9 != 0, F.col("close_price")))
    counts = ingest.insert_observed(base, new, ["date"], lambda df: df.write.format("noop").mode("overwrite").save(), checks={"price": F.col("close_price") > 0})
    return spark.createDataFrame([(counts["inserted"], counts["skipped"], counts["rejected"])], "inserted long, skipped long, rejected long")


def bar_upsert_partitions(spark, sf_dir):
    """The bars since a day merged into a table by month; other months are not read."""
    base, new = _halves(gold_bars(spark, sf_dir))
    path, month = scratch(spark, "bars"), F.date_format("date", "yyyy-MM")
    write_partitions(base, path, "month", month)
    upsert_partitions(new.where(F.col("date") >= F.lit(SINCE).cast("date")), path, BAR_SCHEMA, "month", month, up.merge_bars)
    return read_partitions(spark, path, BAR_SCHEMA, "month").drop("month")


def overlay_quotes(spark, sf_dir):
    """Quotes on every fifth and seventh gold day laid over the aligned series: of gold, of the dollar, or of both."""
    bars = gold_bars(spark, sf_dir)
    day = F.unix_date("date")
    quotes = bars.where((day % 5 == 0) | (day % 7 == 0)).select(F.col("date").cast("timestamp").alias("ts"), F.when(day % 5 == 0, F.col("close_price") + 1).alias("gold"), F.when(day % 7 == 0, F.col("close_price") / 2).alias("dollar"))
    return prices.overlay_quotes(prices.align(bars, dollar_bars(spark, sf_dir)), quotes)


def quote_bytes(spark, sf_dir):
    """Quotes as bytes in GB2312, with the name in it; every eleventh has a byte behind the name that no character has."""
    k = F.col("event_id")
    ascii_fields = F.concat_ws(",", k.cast("string"), *[F.lit("")] * 3, F.lit("2.5"), F.lit("0.5"), F.lit("10:00"), F.lit("50"), F.lit("49"), *[F.lit("")] * 3, F.lit("2024-01-01"))
    # the two characters of gold in GB2312
    name = F.when(k % 11 == 0, F.unhex(F.lit("BBC6BDF0FF"))).otherwise(F.unhex(F.lit("BBC6BDF0")))
    raw = F.concat(F.encode(F.concat(F.lit('hq_str_hf_GC="'), ascii_fields, F.lit(",")), "UTF-8"), name, F.encode(F.lit('"'), "UTF-8"))
    text = payloads.decoded(table(spark, sf_dir, "events").select("event_id", raw.alias("payload")), "payload")
    quote = doc.quote_b(F.col("payload"))
    fields = doc.quote_fields(F.col("payload"), "hq_str_hf_GC")
    return text.select("event_id", quote["price"].alias("price"), quote["prev_close"].alias("prev_close"), F.get(fields, F.lit(13)).alias("name"))


def statistics_document(spark, sf_dir):
    """The monthly rollup's totals, written twice as the document of statistics; what a reader finds is the second."""
    path, bars = scratch(spark, "statistics"), gold_bars(spark, sf_dir)
    for rows in (bars.where("date < '1996-01-01'"), bars):
        write_statistics(rows.agg(F.count("*").alias("days"), F.max("high_price").alias("high"), F.min("low_price").alias("low")), path)
    return read_statistics(spark, path, "days bigint, high double, low double")


def analyzer_mentions(spark, sf_dir):
    """Keywords in the titles of factors, each with how often its factor has come up in the brand."""
    k = F.col("id")
    text = F.concat("title", F.when(k % 2 == 0, " 美元").otherwise(""), F.when(k % 3 == 0, " 通胀").otherwise(""), F.when(k % 5 == 0, " 美联储").otherwise(""))
    docs = factors(spark, sf_dir).select(F.col("subtitle").alias("topic"), k.cast("long").alias("id"), text.alias("text"))
    return analyzers.analyze(docs, "factor_mentions")


def analyzer_sentiment_runs(spark, sf_dir):
    """Runs of one sentiment in each source's news, called from SQL."""
    analyzers.register(spark)
    docs = news_items(spark, sf_dir).select(F.col("source").alias("topic"), F.col("id").cast("long").alias("id"), "sentiment")
    return spark.sql("SELECT * FROM sentiment_runs(TABLE({docs}) PARTITION BY topic ORDER BY id)", docs=docs)


QUERIES = {
    "quote_bytes": quote_bytes,
    "statistics_document": statistics_document,
    "analyzer_mentions": analyzer_mentions,
    "analyzer_sentiment_runs": analyzer_sentiment_runs,
    "factor_quarantine": factor_quarantine,
    "ingest_counters": ingest_counters,
    "bar_upsert_partitions": bar_upsert_partitions,
    "overlay_quotes": overlay_quotes,
}

_INC = f"{_HALVES}, late AS (SELECT * FROM inc WHERE date >= DATE '{SINCE}')"

ORACLE = {
    "quote_bytes": "SELECT event_id, CAST(event_id AS DOUBLE) AS price, 50.0::DOUBLE AS prev_close, '黄金' || CASE WHEN event_id % 11 = 0 THEN chr(65533) ELSE '' END AS name FROM events",
    "statistics_document": f"WITH {GOLD_SQL} SELECT count(*) AS days, max(high_price) AS high, min(low_price) AS low FROM gold",
    "analyzer_mentions": f"""WITH {FACTORS_SQL}, m AS (SELECT subtitle AS topic, CAST(id AS BIGINT) AS id, '美元' AS keyword, 'dollar' AS factor FROM factors WHERE id % 2 = 0
  UNION ALL SELECT subtitle, id, '通胀', 'inflation' FROM factors WHERE id % 3 = 0 UNION ALL SELECT subtitle, id, '美联储', 'fed-policy' FROM factors WHERE id % 5 = 0)
SELECT *, CAST(row_number() OVER (PARTITION BY topic, factor ORDER BY id) AS INTEGER) AS nth FROM m""",
    "analyzer_sentiment_runs": f"""WITH {NEWS_SQL}, n AS (SELECT source, sentiment, id, row_number() OVER (PARTITION BY source ORDER BY id) - row_number() OVER (PARTITION BY source, sentiment ORDER BY id) AS isle FROM news)
SELECT source AS topic, sentiment, CAST(min(id) AS BIGINT) AS first_id, CAST(max(id) AS BIGINT) AS last_id, CAST(count(*) AS INTEGER) AS length FROM n GROUP BY source, sentiment, isle""",
    "factor_quarantine": f"""WITH {FACTORS_SQL}, f AS (SELECT id, CASE WHEN id % 13 = 0 THEN ' ' WHEN id % 26 <> 1 THEN title END AS title, CASE WHEN id % 11 = 0 THEN 'severe' ELSE impact END AS impact,
  CASE WHEN id % 17 = 0 THEN 1.5::DOUBLE WHEN id % 19 <> 0 THEN confidence END AS confidence FROM factors)
SELECT *, CASE WHEN coalesce(trim(title), '') = '' THEN 'title' WHEN impact NOT IN ('high', 'medium', 'low') THEN 'impact' WHEN confidence IS NULL OR confidence NOT BETWEEN 0 AND 1 THEN 'confidence' ELSE '' END AS reason FROM f""",
    "ingest_counters": f"""WITH {GOLD_SQL}{_HALVES}, i AS (SELECT date, {_DAY} AS n FROM inc), twice AS (SELECT * FROM i UNION ALL SELECT * FROM i WHERE n % 4 = 0),
ok AS (SELECT * FROM twice WHERE n % 9 <> 0), fresh AS (SELECT DISTINCT date FROM ok WHERE date NOT IN (SELECT date FROM base))
SELECT (SELECT count(*) FROM fresh) AS inserted, (SELECT count(*) FROM ok) - (SELECT count(*) FROM fresh) AS skipped, (SELECT count(*) FROM twice WHERE n % 9 = 0) AS rejected""",
    "bar_upsert_partitions": f"""WITH {GOLD_SQL}{_INC} SELECT coalesce(b.date, i.date) AS date,
  CASE WHEN i.date IS NULL THEN b.open_price ELSE coalesce(nullif(i.open_price, 0), b.open_price) END AS open_price,
  CASE WHEN i.date IS NULL THEN b.high_price WHEN b.date IS NULL THEN i.high_price ELSE greatest(b.high_price, coalesce(nullif(i.high_price, 0), b.high_price)) END AS high_price,
  CASE WHEN i.date IS NULL THEN b.low_price WHEN b.date IS NULL THEN i.low_price ELSE least(b.low_price, coalesce(nullif(i.low_price, 0), b.low_price)) END AS low_price,
  coalesce(i.close_price, b.close_price) AS close_price, CASE WHEN b.date IS NULL THEN 0 ELSE b.volume END AS volume,
  CASE WHEN i.date IS NULL THEN b.change_percent ELSE i.change_percent END AS change_percent FROM base b FULL JOIN late i ON b.date = i.date""",
    "overlay_quotes": f"""WITH {GOLD_SQL}, {DOLLAR_SQL}, pairs AS (SELECT g.date, g.close_price AS gold_price, d.close_price AS dollar_index FROM gold g JOIN dollar d USING (date)),
q AS (SELECT date, CASE WHEN {_DAY} % 5 = 0 THEN close_price + 1 END AS g, CASE WHEN {_DAY} % 7 = 0 THEN close_price / 2 END AS d FROM gold WHERE {_DAY} % 5 = 0 OR {_DAY} % 7 = 0),
b AS (SELECT coalesce(p.date, q.date) AS date, coalesce(g, gold_price) AS g, coalesce(d, dollar_index) AS d FROM pairs p FULL JOIN q ON p.date = q.date)
SELECT * FROM (SELECT date, last_value(g IGNORE NULLS) OVER (ORDER BY date) AS gold_price, last_value(d IGNORE NULLS) OVER (ORDER BY date) AS dollar_index FROM b) WHERE gold_price IS NOT NULL AND dollar_index IS NOT NULL""",
}
