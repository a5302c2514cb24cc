"""Document, payload, ingest and serving queries on the test tables with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import documents as doc
from tickloom.functions.exprs import safe_double
from tickloom.operators import serving as op
from tickloom.sources import payloads, tables
from tickloom.sources.views import DOLLAR_SQL, GOLD_SQL, dollar_bars, gold_bars, table

SCHEMA = "k bigint, event string"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def json_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return _events(spark, sf_dir).select("event_id", F.coalesce(k, F.lit(-1)).alias("k"))


def answers(events):
    """Answer texts around each event's properties in four forms: fenced, in prose, bare and broken."""
    form = F.col("event_id") % 4
    text = F.when(form == 0, F.concat(F.lit("so:\n```json\n"), "props", F.lit("\n```\nend"))).when(form == 1, F.concat(F.lit("answer "), "props", F.lit(" end"))).when(form == 2, F.col("props")).otherwise(F.lit('{"k":'))
    return events.select("event_id", text.alias("answer"))


def answer_chains(spark, sf_dir):
    chains = ("fence_braces", "braces", "fence", "braces_only")
    got = {c: F.coalesce(doc.parse_answer(F.col("answer"), "k bigint", "k", c)["k"], F.lit(-1)).alias(c) for c in chains}
    return answers(_events(spark, sf_dir)).select("event_id", *got.values())


def quote_parse(spark, sf_dir):
    """Quote payloads of the first format with the event's value; every tenth has a malformed price."""
    price = F.when(F.col("event_id") % 10 == 0, F.lit("abc")).otherwise(F.col("event_id").cast("string"))
    fields = F.concat_ws(",", price, F.lit("x"), F.lit("1.5"), F.lit("2.5"), F.lit("0.5"), F.lit(""), F.lit(""), F.lit("50"), *[F.lit("")] * 4, F.lit("2024-01-01"))
    rows = _events(spark, sf_dir).select("event_id", F.concat(F.lit('v_hf_GC="'), fields, F.lit('"')).alias("payload"))
    return rows.select("event_id", doc.quote_a(F.col("payload")).alias("q")).where("q is not null").select("event_id", "q.price", "q.prev_close", "q.change_pct", "q.date")


def quote_dollar(spark, sf_dir):
    """Dollar payloads of eight to eleven fields; those with fewer than ten give none."""
    n = 8 + F.col("event_id") % 4
    fields = F.array_join(F.concat(F.array(F.lit("t"), F.col("event_id").cast("string")), F.transform(F.sequence(F.lit(3), n), lambda i: F.lit("100"))), ",")
    rows = _events(spark, sf_dir).select("event_id", doc.quote_dollar(F.concat(F.lit('hq_str_DINIW="'), fields, F.lit('"'))).alias("q"))
    return rows.where("q is not null").select("event_id", "q.price", "q.prev_close", "q.change_pct")


def quote_cents(spark, sf_dir):
    body = F.to_json(F.struct(F.struct(F.col("event_id").alias("f43"), F.lit(300).alias("f44"), F.lit(100).alias("f45"), F.lit(200).alias("f46"), F.lit(250).alias("f60")).alias("data")))
    return _events(spark, sf_dir).select("event_id", doc.quote_c(body).alias("q")).select("event_id", "q.price", "q.high", "q.prev_close", "q.change_pct")


def quote_safe(spark, sf_dir):
    """Payloads of the second format; every tenth price is malformed, every seventh payload has too few fields."""
    price = F.when(F.col("event_id") % 10 == 0, F.lit("-")).otherwise(F.col("event_id").cast("string"))
    fields = [price, *[F.lit("")] * 3, F.lit("2.5"), F.lit("0.5"), F.lit("10:00"), F.lit("50"), F.lit("49"), *[F.lit("")] * 3]
    body = F.concat_ws(",", *fields, F.when(F.col("event_id") % 7 != 0, F.lit("2024-01-01")))
    rows = _events(spark, sf_dir).select("event_id", doc.quote_b(F.concat(F.lit('hq_str_hf_GC="'), body, F.lit('"'))).alias("q"))
    return rows.where("q is not null").select("event_id", "q.price", "q.high", "q.low", "q.open", "q.prev_close", "q.change_pct", "q.time")


def history_frame(spark, sf_dir):
    """The daily bars as a data frame of prices and volumes, every fifth volume missing."""
    day = F.unix_date("date")
    frame = gold_bars(spark, sf_dir).select(F.col("date").alias("Date"), *(F.col(f"{c}_price").alias(c.title()) for c in ("open", "high", "low", "close")), F.when(day % 5 != 0, F.col("volume")).alias("Volume"))
    return payloads.bars_from_frame(frame, 4)


def jsonp_payloads(bars):
    """Daily bars as one payload per month."""
    row = F.to_json(F.array(F.col("date").cast("string"), *(F.col(c).cast("string") for c in ("open_price", "high_price", "low_price", "close_price", "volume"))))
    return bars.groupBy(F.date_format("date", "yyyy-MM")).agg(F.concat(F.lit("var GC = ["), F.array_join(F.collect_list(row), ","), F.lit("];")).alias("payload"))


def kline_payloads(bars):
    line = F.concat_ws(",", F.col("date").cast("string"), "open_price", "close_price", "low_price", "high_price", "volume")
    return bars.groupBy(F.date_format("date", "yyyy-MM")).agg(F.to_json(F.struct(F.struct(F.collect_list(line).alias("klines")).alias("data"))).alias("payload"))


def history_jsonp(spark, sf_dir):
    """The daily bars written as payloads and read again."""
    return payloads.bars_from_jsonp(jsonp_payloads(gold_bars(spark, sf_dir)), "2000-01-01")


def history_klines(spark, sf_dir):
    return payloads.bars_from_klines(kline_payloads(gold_bars(spark, sf_dir)), "2000-01-01")


def _index(spark, sf_dir):
    return dollar_bars(spark, sf_dir).withColumn("volume", F.lit(0))


def dollar_jsonp(spark, sf_dir):
    return payloads.without_volume(payloads.bars_from_jsonp(jsonp_payloads(_index(spark, sf_dir)), "2000-01-01"))


def dollar_klines(spark, sf_dir):
    return payloads.without_volume(payloads.bars_from_klines(kline_payloads(_index(spark, sf_dir)), "2000-01-01"))


def dollar_fallback(spark, sf_dir):
    """The index from the first source with rows: payloads of the far future, then those of a data frame."""
    bars = _index(spark, sf_dir)
    frame = bars.select(F.col("date").alias("Date"), *(F.col(f"{c}_price").alias(c.title()) for c in ("open", "high", "low", "close")), F.col("volume").alias("Volume"))
    later = payloads.bars_from_jsonp(jsonp_payloads(bars), "2100-01-01")
    return payloads.first_source([payloads.without_volume(b) for b in (later, payloads.bars_from_frame(frame, 4))])


def answer_array(spark, sf_dir):
    """The array in prose, two copies of each event's properties; a quarter of the answers break off."""
    text = F.when(F.col("event_id") % 4 == 3, F.lit('list: [{"k":')).otherwise(F.concat(F.lit("list: ["), "props", F.lit(","), "props", F.lit("] end")))
    found = _events(spark, sf_dir).select("event_id", doc.parse_array(text, "struct<k:bigint>").alias("a"))
    return found.select("event_id", F.size("a").alias("n"), F.coalesce(F.get("a", F.lit(1))["k"], F.lit(-1)).alias("k"))


def document_pretty(spark, sf_dir):
    kind = F.concat(F.lit("黄金 "), "event_type")
    return _events(spark, sf_dir).select("event_id", doc.pretty(F.struct("event_id", kind.alias("title"), F.lit(None).cast("string").alias("note"))).alias("json"))


def safe_numbers(spark, sf_dir):
    """Number texts of five kinds (empty, blank, malformed, 0.0, whole) under both rules for missing ones."""
    kinds = F.array(F.lit(""), F.lit(" "), F.lit("abc"), F.lit("0.0"), F.col("event_id").cast("string"))
    text = F.get(kinds, (F.col("event_id") % 5).cast("int"))
    return _events(spark, sf_dir).select("event_id", safe_double(text, -1.0).alias("blank_rule"), safe_double(text, -1.0, zero_is_missing=True).alias("zero_rule"))


def json_rows(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"))
    return tables.as_json(rows)


def history_fallback(spark, sf_dir):
    bars = gold_bars(spark, sf_dir).select("date", "close_price")
    return payloads.first_source([bars.where("date < '1900-01-01'"), bars.where("date >= '2001-01-01'"), bars])


def requests(events):
    return events.select(F.col("user_id").alias("key"), "ts")


#: Class, requests and seconds; errors have no limit.
LIMITS = (("view", 3, 172_800), ("click", 1, 86_400), ("purchase", 2, 259_200), ("signup", 0, 60))


def rate_limit_classes(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_type").alias("class"), "ts")
    return op.limit_by_class(rows, spark.createDataFrame(LIMITS, "class string, cap int, seconds int"))


def entries(events):
    return events.select(F.col("event_type").alias("cache_key"), F.unix_timestamp("ts").cast("double").alias("ts"))


AS_OF = 1706572800.0  # 2024-01-30 00:00 UTC


def serve(spark, sf_dir):
    """Per user the cached value, else the stored one, else the default."""
    kind = F.col("event_type")
    rank = F.when(kind == "view", 1).when(kind == "click", 2).otherwise(3)
    ttl = F.when(rank == 1, 7200.0).when(rank == 2, 86400.0)
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("cache_key"), rank.alias("priority"), F.unix_timestamp("ts").cast("double").alias("ts"), ttl.alias("ttl"), F.concat(kind, F.col("event_id")).alias("value"))
    return op.serve(rows, AS_OF).select("cache_key", "priority", "ts", "value")


def serve_forced(spark, sf_dir):
    """A forced refresh: per user the fresh computation comes first, if it has rows enough; else what ``serve`` gives."""
    kind, day = F.col("event_type"), F.unix_timestamp("ts").cast("double")
    computed = kind == "purchase"
    rows = _events(spark, sf_dir).where(kind.isin("view", "click", "purchase")).select(
        F.col("user_id").cast("string").alias("cache_key"), F.when(kind == "view", 1).when(kind == "click", 2).otherwise(3).alias("priority"), day.alias("ts"),
        F.lit(2_592_000.0).alias("ttl"), F.concat(kind, F.lit(" "), F.col("event_id")).alias("value"), computed.alias("computed"),
        (F.col("event_id") % 10).alias("n_rows"), F.when(computed, 4).alias("least_rows"),
    )
    return op.serve(rows, AS_OF, force=True).select("cache_key", "ts", "value", "computed")


def cache_operations(spark, sf_dir):
    """Views put, errors remove and clicks get a user's entry, which lives for a day."""
    does = F.when(F.col("event_type") == "view", "put").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "click", "get")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("cache_key"), "ts", does.alias("op"), F.concat(F.lit("v"), F.col("event_id")).alias("value"))
    return op.served_operations(rows, 86_400.0, 6 * 3_600)


QUERIES = {
    "serve_forced": serve_forced,
    "cache_operations": cache_operations,
    "json_props": json_props,
    "answer_chains": answer_chains,
    "quote_parse": quote_parse,
    "quote_dollar": quote_dollar,
    "quote_safe": quote_safe,
    "history_frame": history_frame,
    "quote_cents": quote_cents,
    "history_jsonp": history_jsonp,
    "history_klines": history_klines,
    "history_fallback": history_fallback,
    "dollar_jsonp": dollar_jsonp,
    "dollar_klines": dollar_klines,
    "dollar_fallback": dollar_fallback,
    "answer_array": answer_array,
    "document_pretty": document_pretty,
    "safe_numbers": safe_numbers,
    "json_rows": json_rows,
    "cache_admin": lambda spark, sf_dir: op.cache_keys(op.invalidate(entries(_events(spark, sf_dir)), ["click", "none"])),
    "rate_window": lambda spark, sf_dir: op.trailing_counts(requests(_events(spark, sf_dir)), 86_400, 2),
    "rate_limit_exact": lambda spark, sf_dir: op.limit_requests(requests(_events(spark, sf_dir)), 86_400, 2),
    "rate_limit_classes": rate_limit_classes,
    "cache_freshness": lambda spark, sf_dir: op.cache_summary(entries(_events(spark, sf_dir)), AS_OF, 7200),
    "serve_priority": serve,
}

_AROUND = "(SELECT event_id, event_id % 4 AS form, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_INDEX = f"""WITH {DOLLAR_SQL} SELECT date, round(open_price, 4) AS open_price, round(high_price, 4) AS high_price, round(low_price, 4) AS low_price,
  round(close_price, 4) AS close_price FROM dollar"""
ORACLE = {
    "serve_forced": f"""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS cache_key, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE -1 END AS p, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS ts,
  event_type || ' ' || event_id AS value, event_type = 'purchase' AS computed FROM events WHERE event_type IN ('view', 'click', 'purchase') AND (event_type <> 'purchase' OR event_id % 10 >= 4)),
r AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY p, ts DESC, value) AS rn FROM c WHERE {AS_OF} - ts < 2592000) SELECT cache_key, ts, value, computed FROM r WHERE rn = 1""",
    "cache_operations": """WITH g AS (SELECT CAST(user_id AS VARCHAR) AS cache_key, ts FROM events WHERE event_type = 'click'), c AS (SELECT CAST(user_id AS VARCHAR) AS cache_key, ts, event_type, 'v' || event_id AS value FROM events WHERE event_type IN ('view', 'error')),
j AS (SELECT g.cache_key, g.ts, c.event_type, c.value, (epoch_us(g.ts) - epoch_us(c.ts)) / 1000000.0::DOUBLE AS age FROM g ASOF LEFT JOIN c ON g.cache_key = c.cache_key AND g.ts >= c.ts)
SELECT cache_key, ts, CASE WHEN event_type = 'view' AND age < 86400 THEN 'hit' ELSE 'miss' END AS event, CASE WHEN event_type = 'view' AND age < 86400 THEN value END AS value, CASE WHEN event_type = 'view' AND age < 86400 THEN age END AS age FROM j""",
    "dollar_jsonp": f"{_INDEX} WHERE date >= DATE '2000-01-01'",
    "dollar_klines": f"{_INDEX} WHERE date >= DATE '2000-01-01'",
    "dollar_fallback": _INDEX,
    "answer_array": f"SELECT event_id, CASE WHEN form < 3 THEN 2 ELSE 0 END AS n, CASE WHEN form < 3 THEN k ELSE -1 END AS k FROM {_AROUND}",
    "document_pretty": """SELECT event_id, '{' || chr(10) || '  "event_id" : ' || event_id || ',' || chr(10) || '  "title" : "黄金 ' || event_type || '",' || chr(10)
  || '  "note" : null' || chr(10) || '}' AS json FROM events""",
    "safe_numbers": """SELECT event_id, CASE event_id % 5 WHEN 4 THEN event_id WHEN 3 THEN 0 ELSE -1 END::DOUBLE AS blank_rule,
  CASE event_id % 5 WHEN 4 THEN event_id ELSE -1 END::DOUBLE AS zero_rule FROM events""",
    "json_rows": """SELECT '{"event_id":' || event_id || ',"kind":' || CASE WHEN event_id % 3 <> 0 THEN '"' || event_type || '"' ELSE 'null' END || '}' AS json FROM events""",
    "cache_admin": "SELECT DISTINCT event_type AS cache_key FROM events WHERE event_type NOT IN ('click', 'none')",
    "rate_limit_exact": """WITH RECURSIVE e AS (SELECT user_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events WHERE ts IS NOT NULL),
walk AS (SELECT user_id, rn, [t] AS times, true AS allowed FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, CASE WHEN len(w.times) < 2 OR w.times[-2] <= e.t - 86400000000 THEN list_append(w.times, e.t)[-2:] ELSE w.times END,
    len(w.times) < 2 OR w.times[-2] <= e.t - 86400000000 FROM walk w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.rn = w.rn + 1)
SELECT e.user_id AS key, e.ts, w.allowed FROM walk w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.rn = w.rn""",
    "rate_limit_classes": f"""WITH RECURSIVE l(class, cap, seconds) AS (VALUES {", ".join(str(x) for x in LIMITS)}),
e AS (SELECT user_id, event_type, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS rn FROM events WHERE ts IS NOT NULL AND event_type IN (SELECT class FROM l)),
c AS (SELECT e.*, cap, seconds * 1000000::BIGINT AS span FROM e JOIN l ON class = event_type),
walk AS (SELECT user_id, event_type, rn, ts, CASE WHEN cap > 0 THEN [t] ELSE [] END AS times, cap > 0 AS allowed, NULL::DOUBLE AS retry_after FROM c WHERE rn = 1
  UNION ALL SELECT c.user_id, c.event_type, c.rn, c.ts, CASE WHEN ok THEN list_append(times, t)[-cap:] ELSE times END, ok, CASE WHEN NOT ok AND cap > 0 THEN (times[-cap] + span - t) / 1000000.0::DOUBLE END
  FROM (SELECT c.*, w.times, cap > 0 AND (len(w.times) < cap OR w.times[-cap] <= c.t - c.span) AS ok FROM walk w JOIN c ON c.user_id IS NOT DISTINCT FROM w.user_id AND c.event_type = w.event_type AND c.rn = w.rn + 1) c)
SELECT user_id AS key, event_type AS class, ts, allowed, retry_after FROM walk
UNION ALL SELECT user_id, event_type, ts, true, NULL FROM events WHERE ts IS NOT NULL AND (event_type IS NULL OR event_type NOT IN (SELECT class FROM l))""",
    "quote_safe": """WITH q AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE CAST(event_id AS DOUBLE) END AS price FROM events WHERE event_id % 7 <> 0)
  SELECT event_id, price, 2.5::DOUBLE AS high, 0.5::DOUBLE AS low, 49.0::DOUBLE AS open, 50.0::DOUBLE AS prev_close, (price - 50.0) / 50.0 * 100 AS change_pct, '2024-01-01 10:00' AS time FROM q""",
    "history_frame": f"""WITH {GOLD_SQL} SELECT date, round(open_price, 4) AS open_price, round(high_price, 4) AS high_price, round(low_price, 4) AS low_price,
  round(close_price, 4) AS close_price, CASE WHEN date_diff('day', DATE '1970-01-01', date) % 5 <> 0 THEN volume ELSE 0 END AS volume FROM gold""",
    "json_props": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events",
    "answer_chains": f"""SELECT event_id, CASE WHEN form < 3 THEN k ELSE -1 END AS fence_braces, CASE WHEN form < 3 THEN k ELSE -1 END AS braces,
  CASE WHEN form IN (0, 2) THEN k ELSE -1 END AS fence, CASE WHEN form < 3 THEN k ELSE -1 END AS braces_only FROM {_AROUND}""",
    "quote_parse": "SELECT event_id, event_id::DOUBLE AS price, 50::DOUBLE AS prev_close, (event_id - 50) / 50::DOUBLE * 100 AS change_pct, '2024-01-01' AS date FROM events WHERE event_id % 10 <> 0",
    "quote_dollar": "SELECT event_id, event_id::DOUBLE AS price, 100::DOUBLE AS prev_close, (event_id - 100) / 100::DOUBLE * 100 AS change_pct FROM events WHERE event_id % 4 >= 2",
    "quote_cents": "SELECT event_id, event_id / 100::DOUBLE AS price, 3::DOUBLE AS high, 2.5::DOUBLE AS prev_close, (event_id / 100::DOUBLE - 2.5::DOUBLE) / 2.5::DOUBLE * 100 AS change_pct FROM events",
    "history_jsonp": f"WITH {GOLD_SQL} SELECT * FROM gold WHERE date >= DATE '2000-01-01'",
    "history_klines": f"WITH {GOLD_SQL} SELECT * FROM gold WHERE date >= DATE '2000-01-01'",
    "history_fallback": f"WITH {GOLD_SQL} SELECT date, close_price FROM gold WHERE date >= DATE '2001-01-01'",
    "rate_window": """SELECT user_id AS key, ts, count(*) OVER w AS n_window, count(*) OVER w > 2 AS over_cap FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)""",
    "cache_freshness": f"""SELECT event_type AS cache_key, count(*) AS entries, count(*) FILTER (WHERE {AS_OF} - floor(epoch(ts)) < 7200) AS fresh,
  max(floor(epoch(ts)))::DOUBLE AS newest FROM events GROUP BY 1""",
    "serve_priority": f"""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS cache_key, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS priority,
  floor(epoch(ts))::DOUBLE AS ts, CASE event_type WHEN 'view' THEN 7200 WHEN 'click' THEN 86400 END AS ttl, event_type || event_id AS value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY priority, ts DESC, value) AS rn FROM c WHERE ttl IS NULL OR {AS_OF} - ts < ttl)
SELECT cache_key, priority, ts, value FROM r WHERE rn = 1""",
}
