import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import analyzers, documents
from tickloom.operators import feeds, ingest, serving, upserts
from tickloom.sources import payloads, tables

FACTORS = "id int, title string, impact string, confidence double"


def test_every_row_goes_to_one_side_with_its_reason(spark, tmp_path):
    rows = [(1, "a", "high", 0.5), (2, None, "high", 0.5), (3, " ", "none", 2.0), (4, "b", "severe", 0.5), (5, "c", None, 0.5), (6, "d", "low", None), (7, "e", "low", -0.1), (8, "f", "medium", 1.0), (8, "f", "medium", 1.0)]
    df = spark.createDataFrame(rows, FACTORS)
    good, rejected = ingest.write_routed(df, ingest.factor_checks(), str(tmp_path / "t"))
    assert good.columns == df.columns and sorted(map(tuple, good.collect())) == [rows[0], rows[7], rows[8]]
    assert {r.id: r.reason for r in rejected.collect()} == {2: "title", 3: "title", 4: "impact", 5: "impact", 6: "confidence", 7: "confidence"}
    assert good.count() + rejected.count() == len(rows)
    none, all_of = ingest.write_routed(df.limit(0), ingest.factor_checks(), str(tmp_path / "e"))
    assert none.count() == all_of.count() == 0
    passed, _ = ingest.write_routed(df, {}, str(tmp_path / "p"))
    assert passed.count() == len(rows)


BAR = "date date, close_price double, volume int"


def test_the_write_counts_what_it_inserts(spark, tmp_path):
    rnd = random.Random(5)
    day = lambda k: None if k == 0 else dt.date(2024, 1, k)
    base = spark.createDataFrame([(day(k), float(k), 0) for k in (0, 1, 2, 3, 3)], BAR)
    rows = [(day(rnd.randint(0, 9)), rnd.choice([1.0, 2.0, None, -1.0]), rnd.randint(0, 99)) for _ in range(60)]
    incoming = spark.createDataFrame(rows, BAR).repartition(3)
    checks = {"price": F.col("close_price") > 0}
    counts = ingest.insert_observed(base, incoming, ["date"], lambda df: df.write.parquet(str(tmp_path / "new")), "volume", checks)
    valid = incoming.where("close_price > 0")
    want = upserts.insert_counts(base, valid, ["date"]).first()
    assert counts == {"inserted": want.inserted, "skipped": want.skipped, "rejected": incoming.count() - valid.count()}
    added = spark.read.parquet(str(tmp_path / "new"))
    both = sorted(map(str, base.union(added).collect()))
    assert added.count() == want.inserted and both == sorted(map(str, upserts.insert_if_absent(base, valid, ["date"], "volume").collect()))
    again = ingest.insert_observed(base.union(added), incoming, ["date"], lambda df: df.write.parquet(str(tmp_path / "none")), "volume", checks)
    assert again == {"inserted": 0, "skipped": valid.count(), "rejected": counts["rejected"]}
    assert ingest.insert_observed(base, incoming.limit(0), ["date"], lambda df: df.write.parquet(str(tmp_path / "empty"))) == {"inserted": 0, "skipped": 0, "rejected": 0}


def walk(rows, limits):
    times, out = {}, []
    for key, kind, ts in sorted((r for r in rows if r[2] is not None), key=lambda r: r[2]):
        if kind not in limits:
            out.append((key, kind, ts, True, None))
            continue
        cap, seconds = limits[kind]
        inside = [t for t in times.get((key, kind), []) if (ts - t).total_seconds() < seconds]
        ok = len(inside) < cap
        if ok:
            times.setdefault((key, kind), []).append(ts)
        out.append((key, kind, ts, ok, None if ok or not cap else seconds - (ts - inside[-cap]).total_seconds()))
    return sorted(out, key=str)


def test_limits_of_classes(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice(["u", "v", None]), rnd.choice(["price", "ai", "news", "none", None]), None if rnd.random() < 0.02 else start + dt.timedelta(milliseconds=rnd.randint(0, 300_000))) for _ in range(400)]
    limits = {"price": (10, 60), "ai": (2, 60), "none": (0, 60)}
    df = spark.createDataFrame(rows, "key string, class string, ts timestamp").repartition(3)
    caps = spark.createDataFrame([(k, *v) for k, v in limits.items()], "class string, cap int, seconds int")
    got = sorted((tuple(r) for r in serving.limit_by_class(df, caps).collect()), key=str)
    want = walk(rows, limits)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-6) for (*_, a), (*_, b) in zip(got, want, strict=True))
    assert serving.limit_by_class(df.limit(0), caps).count() == 0


def test_consensus_renormalises_weights_and_breaks_ties(spark):
    views = [("a", "buy", 10.0, "y"), ("b", "sell", 20.0, "y"), ("c", "buy", None, "y"), ("d", "sell", 40.0, "y"), ("e", None, 50.0, "y"), ("a", "hold", 7.0, "z"), ("x", "buy", 9.0, "z"), ("x", None, None, "w")]
    df = spark.createDataFrame(views, "institution_name string, rating string, target_price double, timeframe string")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 5.0), ("d", 0.0), ("e", 1.0)], "institution_name string, weight double")
    got = {r.timeframe: tuple(r)[1:] for r in feeds.target_consensus(df, weights, ("timeframe",)).collect()}
    # buy and sell have two votes each; buy weighs more
    assert got == {"y": ((30.0 + 20.0 + 50.0) / 5.0, 3, 5.0, "buy", 2), "z": (7.0, 1, 3.0, "hold", 1), "w": (None, 0, None, None, None)}
    assert feeds.target_consensus(df.limit(0), weights, ("timeframe",)).count() == 0


@pytest.mark.parametrize("most", [1, 2])
def test_names_are_a_line_of_the_report(spark, most):
    df = spark.createDataFrame([("b x", "buy"), ("a y", "buy"), (None, "buy"), ("c", None), (None, "sell")], "institution_name string, rating string")
    got = {r.rating: (r.names, r.n_names) for r in feeds.names_by_rating(df, most).collect()}
    assert got == {"buy": ("a" if most == 1 else "a、b", 2), None: ("c", 1), "sell": ("", 0)}


def test_a_rating_lists_all_its_names(spark):
    """More names than the 1,000 that a line once stopped at, some of them twice."""
    df = spark.range(2600).selectExpr("concat('n', lpad(cast(id % 2500 as string), 5, '0'), ' bank') AS institution_name", "'buy' AS rating")
    row = feeds.names_by_rating(df).first()
    assert row.names.split("、") == sorted(f"n{k % 2500:05d}" for k in range(2600)) and row.n_names == 2600


def test_raw_files_in_gb2312(spark, tmp_path):
    """The files' rows are those of the same payload as text; bytes that are no character are replaced."""
    fields = "2600.5,,,,2.5,0.5,10:00,50,49,,,,2024-01-01,"
    for k, name in enumerate(("黄金", "纽约黄金", "")):
        (tmp_path / f"{k}.txt").write_bytes(f'hq_str_hf_GC="{fields}{name}"'.encode("gb2312"))
    (tmp_path / "3.txt").write_bytes(b'hq_str_hf_GC="' + fields.encode() + b'\xff\xbb\xc6"')
    (tmp_path / "4.txt").write_bytes(b"")
    rows = payloads.read_bytes(spark, str(tmp_path))
    got = {r.path[-5]: (r.q, r.f[13] if r.f else None) for r in rows.select("path", documents.quote_b(F.col("payload")).alias("q"), documents.quote_fields(F.col("payload"), "hq_str_hf_GC").alias("f")).collect()}
    text = spark.createDataFrame([(f'hq_str_hf_GC="{fields}"',)], "payload string").select(documents.quote_b(F.col("payload"))).first()[0]
    assert [got[k][1] for k in "0123"] == ["黄金", "纽约黄金", "", "\ufffd黄"] and all(got[k][0] == text for k in "0123") and "4" not in got
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"a"))], "a int, payload binary")
    assert [(r.a, r.payload) for r in payloads.decoded(odd, "payload").orderBy("a").collect()] == [(1, None), (2, "a")]
    with pytest.raises(LookupError):
        payloads.decoded(odd, "payload", "no such charset")


def test_a_document_is_there_at_every_moment(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "n long"
    write = lambda n: tables.write_statistics(spark.range(n).selectExpr("count(*) AS n"), path)
    write(1)
    old = tables.read_statistics(spark, path, schema)
    (tmp_path / "s" / "version=2").mkdir()  # a write that has not ended
    assert tables.read_statistics(spark, path, schema).first().n == 1
    write(2)
    assert old.first().n == 1 and tables.read_statistics(spark, path, schema).first().n == 2
    write(3)
    assert tables.read_statistics(spark, path, schema).first().n == 3
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["version=3", "version=4"]


def test_analyzers_from_frames_and_sql(spark):
    docs = spark.createDataFrame([("t", 1, "美元与通胀", "up"), ("t", 2, None, "up"), ("t", 3, "美元", None), ("u", 4, "none", "up")], "topic string, id long, text string, sentiment string")
    got = sorted(map(tuple, analyzers.analyze(docs, "factor_mentions").collect()))
    assert got == [("t", 1, "美元", "dollar", 1), ("t", 1, "通胀", "inflation", 1), ("t", 3, "美元", "dollar", 2)]
    assert "sentiment_runs" in analyzers.register(spark)
    runs = spark.sql("SELECT * FROM sentiment_runs(TABLE({docs}) PARTITION BY topic ORDER BY id)", docs=docs).collect()
    assert sorted(map(tuple, runs), key=str) == sorted([("t", "up", 1, 2, 2), ("t", None, 3, 3, 1), ("u", "up", 4, 4, 1)], key=str)
    assert analyzers.analyze(docs.limit(0), "sentiment_runs").count() == 0
    with pytest.raises(ValueError, match="no analyzer"):
        analyzers.analyze(docs, "other")
