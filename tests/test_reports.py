import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickloom.functions import documents, labels
from tickloom.operators import reports
from tickloom.sources import tables

BARS = "date date, open_price double, high_price double, low_price double, close_price double, volume int"


def test_lines_of_no_rows(spark):
    bars = spark.createDataFrame([], BARS)
    assert reports.price_lines(bars).first().context == "暂无价格数据"
    news = spark.createDataFrame([], "id int, title string, published_at timestamp, sentiment string")
    assert reports.news_lines(news).first().context == "暂无新闻数据"
    assert reports.sentiment_lines(news).first().context == "暂无数据"


def test_lines_of_nulls(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, "t", "d", "low")], "id int, title string, description string, impact string")
    assert reports.factor_lines(rows).first().context == "- :  (影响强度: 中)\n- t: d (影响强度: low)"
    inst = spark.createDataFrame([(1, "A", 10.0, "bullish", None, "x" * 300)], "id int, institution_name string, target_price double, rating string, timeframe string, reasoning string")
    assert reports.institution_lines(inst).first().context == f"- A: 目标价$10.00, 评级: bullish, 时间框架: N/A, 理由: {'x' * 100}..."


def test_running_extremes_are_those_so_far(spark):
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k * 1700)
    rows = [(at(k), float(k * 7919 % 101), "x") for k in range(150)] + [(at(3), None, "null"), (None, 999.0, "no time")]
    got = reports.running_extremes(spark.createDataFrame(rows, "ts timestamp, price double, _hi string")).collect()
    assert len(got) == len(rows)
    assert [(r.day_high, r.day_low) for r in got if r.ts is None] == [(None, None)]
    for r in (r for r in got if r.ts is not None):
        so_far = [p for t, p, _ in rows if p is not None and t is not None and t.date() == r.ts.date() and t <= r.ts]
        assert (r.day_high, r.day_low) == (max(so_far), min(so_far))


def test_labels(spark):
    row = spark.range(1).select(
        labels.dollars(F.lit(-1234.5)).alias("a"), labels.thousands(F.lit(4480.0)).alias("b"), labels.signed(F.lit(1.254)).alias("c"),
        labels.impact_label(F.lit(None).cast("string")).alias("d"), labels.status_color(F.lit("回调")).alias("e"), labels.short_day(F.lit("2025-01-02").cast("date")).alias("f"),
    ).first()
    assert tuple(row) == ("-$1,234.50", "$4.5K", "+1.25", "中影响", "amber", "1/2")
    with pytest.raises(Exception, match="unknown value"):
        spark.range(1).select(labels.checked(F.lit("odd"), ("high",))).collect()


def test_tables_are_created_once(spark):
    for _ in range(2):
        tables.create_tables(spark, "market_test")
    assert {r.tableName for r in spark.sql("SHOW TABLES IN market_test").collect()} == set(tables.TABLES)
    spark.sql("DROP DATABASE market_test CASCADE")


def test_documents_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, ("名", None))], "id int, doc struct<name:string,price:double>")
    doc = documents.override(documents.with_defaults(F.col("doc"), {"price": F.lit(5067.0)}), "price", F.lit(None).cast("double"))
    text = df.select(documents.pretty(doc).alias("j")).first().j
    assert json.loads(text) == {"name": "名", "price": 5067.0} and "名" in text and "\n" in text
    assert json.loads(tables.as_json(df).first().json) == {"id": 1, "doc": {"name": "名", "price": None}}
    tables.write_statistics(df.select("id"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().id == 1
