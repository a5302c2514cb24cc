"""News and opinion queries on the test tables with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.exprs import first_keyword
from tickloom.operators import feeds as op
from tickloom.operators import indicators as ind
from tickloom.operators import upserts as up
from tickloom.sources import payloads
from tickloom.sources.views import FACTORS_SQL, INSTITUTIONS_SQL, NEWS_SQL, PREDICTIONS_SQL, factors, institutions, news_items, predictions, table

AS_OF = "2024-01-30 00:00:00"
#: Words of the test titles in the role of the factor keywords, in order.
KEYWORDS = {"antique": "fed-policy", "blue": "central-bank", "metal": "dollar", "a": "inflation"}
LOGOS = {"CHINA": "CN", "GERMANY": "DE", "NATION_1": "N1", "NATION_2": "N2"}


def _news(run):
    return lambda spark, sf_dir: run(news_items(spark, sf_dir))


def _factors(run):
    return lambda spark, sf_dir: run(factors(spark, sf_dir))


def _inst(run):
    return lambda spark, sf_dir: run(institutions(spark, sf_dir))


def news_dedup(spark, sf_dir):
    """Documents in the role of a feed whose url is the text: those of even ids are stored, the others come in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("url"))
    fresh = up.insert_if_absent(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), ["url"], "doc_id")
    return fresh.select("doc_id", F.md5("url").alias("url_md5"))


def factor_upsert(all_factors):
    """The factors of even ids as the table, merged with the others and every third by (type, title)."""
    cols = ["type", "title", "subtitle", "description", "impact"]
    base = all_factors.where("id % 2 = 0").groupBy("type", "title").agg(*(F.max_by(c, "id").alias(c) for c in cols[2:])).select(cols)
    new = all_factors.where("id % 2 = 1 OR id % 3 = 0").select(*cols, F.col("id").alias("seq")).withColumn("impact", F.when(F.col("seq") % 5 != 0, F.col("impact")))
    return up.upsert_by_key(base, new, ["type", "title"], {"impact": "medium", "subtitle": "", "description": ""})


def institution_upsert(all_rows):
    base = all_rows.where("id % 2 = 0").select("institution_name", "logo", "rating", "target_price")
    new = all_rows.where("id % 2 = 1 OR id % 3 = 0").select("institution_name", F.lit("NEW").alias("logo"), F.lit("neutral").alias("rating"), (F.col("target_price") + 1).alias("target_price"), F.col("id").alias("seq"))
    return up.upsert_by_key(base, new, ["institution_name"], {}, insert_only=("logo",))


def fresh_gate(all_rows):
    return op.fresh_rows(all_rows.withColumn("updated_at", F.col("id") * 60), as_of=6000, ttl=7200, least=4, take=5)


def consensus(all_rows):
    """Per timeframe; weights go from 0.25 to 1 with the institution, every seventh has none."""
    weights = all_rows.where("id % 7 <> 0").select("institution_name", ((F.col("id") % 4 + 1) / 4.0).alias("weight"))
    found = op.target_consensus(all_rows, weights, ("timeframe",))
    return found.withColumn("weighted_target", F.round("weighted_target", 4))


def advice(spark, sf_dir):
    one = lambda kind, name: factors(spark, sf_dir).where(F.col("type") == kind).agg(F.count("*").alias(name), F.min("title").alias(f"{name}_first"))
    stats = news_items(spark, sf_dir).agg(F.count("*").alias("news"))
    inst = op.rating_counts(institutions(spark, sf_dir)).select(F.col("bullish").alias("bullish_ratings"))
    return op.advice_context(stats, one("bullish", "bullish_factors"), one("bearish", "bearish_factors"), inst)


def fusion(all_rows):
    score = all_rows.select("id", (F.col("id") % 7).cast("double").alias("technical"), (F.col("id") % 5).cast("double").alias("fundamentals"), (F.col("id") % 3).cast("double").alias("sentiment"), (F.col("id") % 2).cast("double").alias("institutional"))
    scored = ind.fused_score(score)
    return scored.select("id", F.round("score", 6).alias("score"), ind.sentiment_band(F.col("sentiment") - 1).alias("band"))


def feed_union(spark, sf_dir):
    """The feeds of five sources united, five items of each, with their text cut to 8 characters."""
    rows = news_items(spark, sf_dir).select("title", F.col("title").alias("content"), "source", F.col("published_at").alias("published"))
    return payloads.union_feeds([rows.where(F.col("source") == f"src{k}") for k in range(5)], 5, 8)


QUERIES = {
    "news_filter_topn": _news(lambda n: op.newest(op.filtered(n, source="src1", sentiment="positive"), "published_at", 20)),
    "news_page": _news(lambda n: op.newest(n, "published_at", 20, offset=40)),
    "news_by_id": _news(lambda n: n.where(F.col("id") == 77).limit(1)),
    "news_recent_24h": _news(lambda n: op.recent(n, AS_OF)),
    "news_range": _news(lambda n: op.published_between(n, "2024-01-05", "2024-01-06")),
    "news_keyword": _news(lambda n: op.by_keyword(n, "Error")),
    "sentiment_summary": _news(op.sentiment_counts),
    "sentiment_ratio": _news(op.sentiment_shares),
    "news_per_source_top5": _news(op.top_per_source),
    "news_context_lines": _news(op.context_lines),
    "news_feed_union": feed_union,
    "news_dedup_ingest": news_dedup,
    "news_tfidf": _news(lambda n: ind.keyword_weights(n, 2).select("id", "word", F.round("weight", 6).alias("weight"), "rank")),
    "factor_topn": _factors(lambda f: op.newest(op.filtered(f, type="bullish"), "id", 10).select("id", F.col("type").alias("factor_type"), "title", F.array_join("details", "|").alias("details"), "impact", "confidence")),
    "factor_keyword_id": _factors(lambda f: f.select("id", first_keyword(F.col("title"), KEYWORDS, "other").alias("factor_id"))),
    "high_impact_count": _factors(op.high_impact),
    "factor_numbered": _factors(lambda f: f.select("id", op.numbered(F.slice("details", 1, 20)).alias("lines"))),
    "factor_upsert": _factors(factor_upsert),
    "news_recently_stored": _news(lambda n: op.recently_stored(n, AS_OF, 240, column="published_at").select("id", "title")),
    "institution_counts": _inst(op.rating_counts),
    "institution_names": _inst(op.names_by_rating),
    "institution_logo": _inst(lambda i: i.select("id", first_keyword(F.col("logo"), LOGOS, "BANK").alias("mark"))),
    "institution_upsert": _inst(institution_upsert),
    "target_range": _inst(lambda i: op.target_range(i).withColumn("average", F.round("average", 4))),
    "target_consensus": _inst(consensus),
    "fresh_gate": _inst(fresh_gate),
    "prediction_latest": lambda spark, sf_dir: op.newest(predictions(spark, sf_dir), "id", 1),
    "prediction_topn": lambda spark, sf_dir: op.newest(predictions(spark, sf_dir), "id", 10).select("id", F.col("prediction_type").alias("type"), "target_price", "confidence"),
    "advice_context": advice,
    "fusion_score": _inst(fusion),
}

_N, _F, _I, _P = (f"WITH {x}" for x in (NEWS_SQL, FACTORS_SQL, INSTITUTIONS_SQL, PREDICTIONS_SQL))
_FIRST = lambda col, table_: "CASE " + " ".join(f"WHEN contains({col}, '{k}') THEN '{v}'" for k, v in table_.items())

ORACLE = {
    "news_filter_topn": f"{_N} SELECT * FROM news WHERE source = 'src1' AND sentiment = 'positive' ORDER BY published_at DESC, id LIMIT 20",
    "news_page": f"{_N} SELECT * FROM news ORDER BY published_at DESC, id LIMIT 20 OFFSET 40",
    "news_by_id": f"{_N} SELECT * FROM news WHERE id = 77",
    "news_recent_24h": f"{_N} SELECT * FROM news WHERE published_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}'",
    "news_range": f"{_N} SELECT * FROM news WHERE published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'",
    "news_keyword": f"{_N} SELECT * FROM news WHERE contains(lower(title), 'error')",
    "sentiment_summary": f"{_N} SELECT count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, count(*) FILTER (WHERE sentiment = 'negative') AS negative FROM news",
    "sentiment_ratio": f"""{_N}, c AS (SELECT count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
  count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) AS total FROM news)
SELECT *, positive::DOUBLE / total AS positive_share, neutral::DOUBLE / total AS neutral_share, negative::DOUBLE / total AS negative_share,
  CASE WHEN positive > negative THEN 'positive' WHEN negative > positive THEN 'negative' ELSE 'neutral' END AS trend FROM c""",
    "news_per_source_top5": f"{_N} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY published_at DESC, id) AS INTEGER) AS rn FROM news) WHERE rn <= 5",
    "news_context_lines": f"{_N} SELECT string_agg('[' || source || '] ' || title, chr(10) ORDER BY published_at DESC, id) AS context FROM (SELECT * FROM news ORDER BY published_at DESC, id LIMIT 15)",
    "news_feed_union": f"{_N} SELECT title, substring(title, 1, 8) AS content, source, published_at AS published FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, title) AS rn FROM news) WHERE rn <= 5",
    "news_dedup_ingest": """WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM a) GROUP BY text)
SELECT doc_id, md5(text) AS url_md5 FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "news_tfidf": f"""{_N}, s AS (SELECT id, title FROM news), w AS (SELECT id, unnest(regexp_split_to_array(lower(title), '[^a-z0-9]+')) AS word FROM s),
tf AS (SELECT id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT id, word, tf * ln((SELECT count(DISTINCT id) FROM s) / df::DOUBLE) AS weight FROM tf JOIN df USING (word)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS INTEGER) AS rank FROM x) SELECT id, word, round(weight, 6) AS weight, rank FROM r WHERE rank <= 2""",
    "factor_topn": f"{_F} SELECT id, type AS factor_type, title, array_to_string(details, '|') AS details, impact, confidence FROM factors WHERE type = 'bullish' ORDER BY id DESC LIMIT 10",
    "factor_keyword_id": f"{_F} SELECT id, {_FIRST('title', KEYWORDS)} ELSE 'other' END AS factor_id FROM factors",
    "high_impact_count": f"{_F} SELECT type, count(*) FILTER (WHERE impact = 'high') AS high, count(*) AS total FROM factors GROUP BY type",
    "factor_numbered": f"{_F} SELECT id, array_to_string(list_transform(details, lambda x, i: i || '. ' || x), chr(10)) AS lines FROM factors",
    "news_recently_stored": f"WITH {NEWS_SQL} SELECT id, title FROM news WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR ORDER BY published_at DESC, id LIMIT 20",
    "factor_upsert": f"""{_F}, a AS (SELECT type, title, arg_max(subtitle, id) AS subtitle, arg_max(description, id) AS description, arg_max(impact, id) AS impact FROM factors WHERE id % 2 = 0 GROUP BY 1, 2),
b AS (SELECT type, title, arg_max(subtitle, id) AS subtitle, arg_max(description, id) AS description, arg_max(CASE WHEN id % 5 <> 0 THEN impact ELSE 'medium' END, id) AS impact FROM factors WHERE id % 2 = 1 OR id % 3 = 0 GROUP BY 1, 2)
SELECT coalesce(a.type, b.type) AS type, coalesce(a.title, b.title) AS title, coalesce(b.subtitle, a.subtitle) AS subtitle, coalesce(b.description, a.description) AS description,
  coalesce(b.impact, a.impact) AS impact FROM a FULL JOIN b ON a.type = b.type AND a.title = b.title""",
    "institution_counts": f"{_I} SELECT count(*) FILTER (WHERE rating = 'bullish') AS bullish, count(*) FILTER (WHERE rating = 'bearish') AS bearish, count(*) FILTER (WHERE rating = 'neutral') AS neutral FROM institutions",
    "institution_names": f"{_I} SELECT rating, string_agg(string_split(institution_name, ' ')[1], '、' ORDER BY string_split(institution_name, ' ')[1]) AS names, count(*) AS n_names FROM institutions GROUP BY rating",
    "institution_logo": f"{_I} SELECT id, {_FIRST('logo', LOGOS)} ELSE 'BANK' END AS mark FROM institutions",
    "institution_upsert": f"""{_I}, a AS (SELECT * FROM institutions WHERE id % 2 = 0), b AS (SELECT * FROM institutions WHERE id % 2 = 1 OR id % 3 = 0)
SELECT coalesce(a.institution_name, b.institution_name) AS institution_name, CASE WHEN a.id IS NULL THEN 'NEW' ELSE a.logo END AS logo,
  CASE WHEN b.id IS NULL THEN a.rating ELSE 'neutral' END AS rating, coalesce(b.target_price + 1, a.target_price) AS target_price FROM a FULL JOIN b ON a.institution_name = b.institution_name""",
    "target_range": f"{_I} SELECT min(target_price) AS lowest, max(target_price) AS highest, round(avg(target_price), 4) AS average, (SELECT rating FROM institutions GROUP BY rating ORDER BY count(*) DESC, rating LIMIT 1) AS consensus FROM institutions",
    "target_consensus": f"""{_I}, w AS (SELECT *, CASE WHEN id % 7 <> 0 THEN (id % 4 + 1) / 4.0::DOUBLE END AS weight FROM institutions),
t AS (SELECT timeframe, round(sum(weight * target_price) / sum(weight), 4) AS weighted_target, CAST(count(weight) AS BIGINT) AS n_targets, sum(weight) AS total_weight FROM w GROUP BY timeframe),
v AS (SELECT timeframe, rating, count(*) AS votes, row_number() OVER (PARTITION BY timeframe ORDER BY count(*) DESC, coalesce(sum(weight), 0) DESC, rating) AS rn FROM w GROUP BY timeframe, rating)
SELECT t.*, v.rating, v.votes FROM t JOIN v USING (timeframe) WHERE rn = 1""",
    "fresh_gate": f"{_I}, f AS (SELECT *, id * 60 AS updated_at FROM institutions WHERE 6000 - id * 60 <= 7200) SELECT * FROM f WHERE (SELECT count(*) FROM f) >= 4 ORDER BY id LIMIT 5",
    "prediction_latest": f"{_P} SELECT * FROM predictions ORDER BY id DESC LIMIT 1",
    "prediction_topn": f"{_P} SELECT id, prediction_type AS type, target_price, confidence FROM predictions ORDER BY id DESC LIMIT 10",
    "advice_context": f"""{_F}, {INSTITUTIONS_SQL} SELECT (SELECT count(*) FROM events) AS news,
  count(*) FILTER (WHERE type = 'bullish') AS bullish_factors, min(title) FILTER (WHERE type = 'bullish') AS bullish_factors_first,
  count(*) FILTER (WHERE type = 'bearish') AS bearish_factors, min(title) FILTER (WHERE type = 'bearish') AS bearish_factors_first,
  (SELECT count(*) FROM institutions WHERE rating = 'bullish') AS bullish_ratings FROM factors""",
    "fusion_score": f"""{_I} SELECT id, round((id % 7) * 0.3::DOUBLE + (id % 5) * 0.25::DOUBLE + (id % 3) * 0.25::DOUBLE + (id % 2) * 0.2::DOUBLE, 6) AS score,
  CASE id % 3 WHEN 2 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'neutral' END AS band FROM institutions""",
}
