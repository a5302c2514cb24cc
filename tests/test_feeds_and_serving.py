import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import documents as doc
from tickloom.functions.exprs import first_keyword, safe_double
from tickloom.operators import feeds, serving
from tickloom.sources import payloads

NEWS = "id int, title string, source string, published_at timestamp, sentiment string"
T = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


@pytest.fixture(scope="module")
def news(spark):
    return spark.createDataFrame([(k, f"t{k}", f"s{k % 2}", T(k), "neutral") for k in range(12)], NEWS)


def test_missing_classes_count_zero(news):
    assert feeds.sentiment_counts(news).first().asDict() == {"positive": 0, "neutral": 12, "negative": 0}
    empty = feeds.sentiment_shares(news.where("false")).first()
    assert (empty.total, empty.positive_share, empty.trend) == (0, 0.0, "neutral")


def test_news_selection(news):
    assert [r.id for r in feeds.newest(feeds.filtered(news, source="s1", sentiment=None), "published_at", 2).collect()] == [11, 9]
    assert [r.id for r in feeds.newest(news, "published_at", 2, offset=2).collect()] == [9, 8]
    assert feeds.recent(news, "2024-01-01 11:00:00", hours=3).count() == 4
    assert feeds.top_per_source(news, 2).count() == 4
    assert feeds.context_lines(news, 2).first().context == "[s1] t11\n[s0] t10"
    assert feeds.context_lines(news.where("false"), 2).first().context == "no recent news"
    with pytest.raises(ValueError, match="limit"):
        feeds.newest(news, "published_at", 101)


def test_freshness_gate(spark):
    rows = spark.createDataFrame([(k, 100 - k) for k in range(6)], "id int, updated_at int")
    assert feeds.fresh_rows(rows, 100, 2, least=4, take=9).count() == 0
    assert [r.id for r in feeds.fresh_rows(rows, 100, 3, least=4, take=2).collect()] == [0, 1]


def test_keyword_order(spark):
    got = spark.createDataFrame([("美元与美联储",), ("美元",), ("x",)], "t string").select(first_keyword(F.col("t"), feeds.FACTOR_IDS, "other"))
    assert [r[0] for r in got.collect()] == ["fed-policy", "dollar", "other"]


def test_safe_double(spark):
    got = spark.createDataFrame([("1.5",), ("",), (" ",), (None,), ("abc",)], "t string").select(safe_double(F.col("t")))
    assert [r[0] for r in got.collect()] == [1.5, 0.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("text", "found"),
    [("so\n```json\n{\"a\": [1]}\n```\nend", (1, 1, 1, 1)), ("x {\"a\": [1]} y", (1, 1, 0, 1)), ("{\"a\": [1]}", (1, 1, 1, 1)), ("{\"a\":", (0, 0, 0, 0)), ("```\n{\"a\": [1]}\n```", (1, 1, 1, 1)), (None, (0, 0, 0, 0))],
)
def test_answer_chains(spark, text, found):
    row = spark.createDataFrame([(text,)], "t string").select(*(doc.parse_answer(F.col("t"), "a array<int>", "a", c).isNotNull() for c in ("fence_braces", "braces", "fence", "braces_only"))).first()
    assert tuple(map(int, row)) == found


def test_array_answers(spark):
    rows = spark.createDataFrame([("x [1, 2] y",), ("none",), (None,)], "t string").select(doc.parse_array(F.col("t"), "int"))
    assert [r[0] for r in rows.collect()] == [[1, 2], [], []]


def test_quotes(spark):
    a = 'v_hf_GC="100,x,99,101,98,,,80,,,,,2025-01-02"'
    b = 'var hq_str_hf_GC="100,,,,abc,98,10:00,80,99,,,,2025-01-02"'
    rows = spark.createDataFrame([(a, b)], "a string, b string").select(
        doc.quote_a(F.col("a")).alias("a"), doc.quote_a(F.replace("a", F.lit("100"), F.lit("abc"))).alias("bad"), doc.quote_b(F.col("b")).alias("b"), doc.quote_dollar(F.lit('hq_str_DINIW="t,1,2,3,4,5,6,7,8"')).alias("short"), doc.quote_c(F.lit('{"data":{"f43":12345,"f44":1,"f45":1,"f46":1,"f60":0}}')).alias("c")
    )
    row = rows.first()
    assert (row.a.price, row.a.change_pct) == (100.0, 25.0) and row.bad is None and row.short is None
    assert (row.b.high, row.b.time) == (0.0, "2025-01-02 10:00") and (row.c.price, row.c.change_pct) == (123.45, 0.0)


def test_history_payloads(spark):
    jsonp = spark.createDataFrame([('var GC =\n [["2025-01-02","1","3","0.5","2","10"],["bad","1","1","1","1","1"],["2024-01-01","1","1","1","1","1"]];',)], "payload string")
    row = payloads.bars_from_jsonp(jsonp, "2025-01-01").collect()
    assert len(row) == 1 and (row[0].high_price, row[0].volume) == (3.0, 10)
    lines = spark.createDataFrame([('{"data":{"klines":["2025-01-02,1,2,0.5,3,10,9","2025-01-03,1,2,3,0.5,10","short"]}}',)], "payload string")
    got = payloads.bars_from_klines(lines, "2025-01-01").orderBy("date").collect()
    assert [(r.low_price, r.high_price) for r in got] == [(0.5, 3.0), (0.5, 3.0)]
    with pytest.raises(Exception, match="all sources are empty"):
        payloads.first_source([spark.range(0), spark.range(0)]).collect()


def test_rss_and_cache(spark, tmp_path):
    items = "".join(f"<item><title>n{k}</title><description>{'d' * 300}</description><link>u{k}</link><pubDate>2024-01-0{k}</pubDate></item>" for k in range(1, 8))
    (tmp_path / "feed.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    feed = payloads.read_rss(spark, str(tmp_path / "feed.xml"), "src")
    out = payloads.union_feeds([feed, feed.withColumn("source", F.lit("other"))], 5, 200)
    assert out.count() == 10 and out.select(F.max(F.length("content"))).first()[0] == 200
    payloads.write_cache(spark.createDataFrame([("x", 1)], "a string, b int"), str(tmp_path / "cache"), 5.0, "now")
    back = payloads.read_cache(spark, str(tmp_path / "cache"), "struct<a:string,b:int>").first()
    assert (back.data.a, back._timestamp) == ("x", 5.0)


def test_serving(spark):
    rows = [("k", 1, 10.0, 50.0, "stale"), ("k", 2, 90.0, 50.0, "stored"), ("k", 3, 0.0, None, "default"), ("d", 3, 0.0, None, "default"), ("n", 1, 99.0, 50.0, None)]
    df = spark.createDataFrame(rows, "cache_key string, priority int, ts double, ttl double, value string")
    assert {r.cache_key: r.value for r in serving.serve(df, 100.0).collect()} == {"k": "stored", "d": "default"}
    assert serving.invalidate(df, ["k"]).count() == 2 and serving.invalidate(df).count() == 0


def test_limiter_does_not_count_refusals(spark):
    rnd = random.Random(1)
    times = sorted(rnd.sample(range(600), 150))
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for t in times], "key string, ts timestamp")
    allowed, expected = [], []
    for t in times:
        ok = sum(1 for x in allowed if x > t - 60) < 5
        expected.append(ok)
        if ok:
            allowed.append(t)
    assert [r.allowed for r in serving.limit_requests(df, 60, 5).orderBy("ts").collect()] == expected


def test_limiter_walks_a_key_across_batches(spark):
    """Keys go through in sorted batches: no array of a key's requests exists, and nothing is lost where batches part."""
    rnd = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", "", None]), start + dt.timedelta(seconds=rnd.randint(0, 400))) for _ in range(600)]
    df = spark.createDataFrame(rows + [("b", None)], "key string, ts timestamp")
    expected, allowed = [], {}
    for k, t in sorted(rows, key=lambda r: r[1]):
        times = allowed.setdefault(k, [])
        ok = sum(1 for x in times if x > t - dt.timedelta(seconds=30)) < 3
        if ok:
            times.append(t)
        expected.append((k, t, ok))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = serving.limit_requests(df, 30, 3)
        assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)
        assert serving.limit_requests(df, 30, 0).where("allowed").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_a_failing_write_keeps_the_old_document(spark, tmp_path):
    path = str(tmp_path / "doc")
    payloads.write_cache(spark.createDataFrame([("x", 1)], "a string, b int"), path, 5.0, "now")
    bad = spark.createDataFrame([("y", 2)], "a string, b int").withColumn("a", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        payloads.write_cache(bad, path, 6.0, "later")
    schema = "struct<a:string,b:int>"
    assert payloads.read_cache(spark, path, schema).first().data.a == "x"
    payloads.write_cache(spark.createDataFrame([("z", 3)], "a string, b int"), path, 7.0, "later")
    assert payloads.read_cache(spark, path, schema).first().data.a == "z"
    assert [p.name for p in tmp_path.iterdir()] == ["doc"]


def test_a_failing_feed_leaves_the_others(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>t</title><link>u</link></item></channel></rss>")
    frames, failures = payloads.read_feeds(spark, {"a": str(tmp_path / "a.xml"), "b": str(tmp_path / "none.xml")})
    assert [r.title for r in payloads.union_feeds(frames).collect()] == ["t"] and list(failures) == ["b"]


def test_forced_and_gated_serving(spark):
    rows = [("k", 1, 90.0, 60.0, "cached", None, None, False), ("k", 2, 95.0, 60.0, "rows", 3, 4, False), ("k", 3, 99.0, 60.0, "computed", None, None, True), ("m", 2, 95.0, 60.0, "rows", 3, 4, False), ("m", 9, 0.0, None, "default", None, None, False)]
    df = spark.createDataFrame(rows, "cache_key string, priority int, ts double, ttl double, value string, n_rows int, least_rows int, computed boolean")
    pick = lambda force: {r.cache_key: r.value for r in serving.serve(df, 100.0, force).collect()}
    assert pick(False) == {"k": "cached", "m": "default"} and pick(True) == {"k": "computed", "m": "default"}
    assert sorted(r.cache_key for r in serving.cache_keys(df.select("cache_key")).collect()) == ["k", "m"]


def test_recently_stored(news):
    got = feeds.recently_stored(news, "2024-01-01 08:00:00", hours=2, cap=3, column="published_at").collect()
    assert [r.id for r in got] == [11, 10, 9]


def test_bars_of_a_frame(spark):
    frame = spark.createDataFrame([("2024-01-02", 1.23456, 2.0, 0.5, 1.5, float("nan")), ("2024-01-03", 1.0, 2.0, 0.5, 1.5, 7.9), ("2024-01-04", 1.0, 2.0, 0.5, 1.5, None)], "Date string, Open double, High double, Low double, Close double, Volume double")
    assert [(r.open_price, r.volume) for r in payloads.bars_from_frame(frame, 4).orderBy("date").collect()] == [(1.2346, 0), (1.0, 7), (1.0, 0)]


def test_tables_of_a_database_are_read_in_ranges(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:bars;create=true"
    rows = spark.range(100).select(F.col("id").alias("ID"), (F.col("id") * 1.5).alias("PRICE"))
    rows.write.jdbc(url, "BARS", mode="overwrite")
    whole = payloads.read_jdbc(spark, url, "BARS")
    ranges = payloads.read_jdbc(spark, url, "BARS", "ID", ("10", "60"), 4)
    assert (whole.rdd.getNumPartitions(), ranges.rdd.getNumPartitions()) == (1, 4)
    expected = [(k, k * 1.5) for k in range(100)]
    # the bounds only cut the ranges; rows outside them are read too
    assert all(sorted(map(tuple, d.collect())) == expected for d in (whole, ranges))


def test_zero_text_can_count_as_missing(spark):
    rows = spark.createDataFrame([(None,), (" ",), ("0.0",), ("0",), ("7",)], "t string")
    got = rows.select(safe_double(F.col("t"), -1.0), safe_double(F.col("t"), -1.0, zero_is_missing=True)).collect()
    assert [tuple(r) for r in got] == [(-1.0, -1.0), (-1.0, -1.0), (0.0, -1.0), (0.0, 0.0), (7.0, 7.0)]


def test_a_null_key_survives_the_removal_of_others(spark):
    entries = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 1.0)], "cache_key string, ts double")
    assert {r.cache_key for r in serving.invalidate(entries, ["a"]).collect()} == {"b", None}
    assert serving.invalidate(entries).isEmpty()
