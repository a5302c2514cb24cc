import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import exact_dedup, importance_resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def runs(text, grams):
    w = WORD.findall((text or "").translate(FOLD))
    return len(w), [" ".join(w[i : i + g]) for g in range(1, grams + 1) for i in range(len(w) - g + 1)]


def brute_resample(docs, target, grams=1, buckets=10_000, least=20, percent=10):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for rows, counts in ((docs, s), (target, t)):
        for _, text in rows:
            counts.update(map(at, runs(text, grams)[1]))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for k, text in docs:
        n, found = runs(text, grams)
        weight = sum(gain(at(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        ranks.setdefault(r, []).append(rank)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in out), key=str)


def texts(seed, n):
    rnd = random.Random(seed)
    pool = ["Alpha", "beta7", "gamma-delta", "Été", "漢字", "x" * 70, "the", "of", "a_b", "ÀÉ9"]
    return [(i, " ".join(rnd.choice(pool) for _ in range(rnd.choice([0, 5, 19, 20, 21, 60])))) for i in range(n)]


@pytest.mark.parametrize(("grams", "buckets", "percent"), [(1, 10_000, 10), (2, 50, 40), (3, 100_000, 100), (1, 10_000, 0)])
def test_resampling_equals_plain_python(spark, frame, odd, grams, buckets, percent):
    docs, target = texts(1, 150) + odd + [(None, "w " * 30), (None, "w " * 30), (7, "w " * 30)], texts(2, 9) + [(1, None)]
    got = importance_resampling.resample(frame(docs, rank="r", score="s", id=1), frame(target), grams=grams, buckets=buckets, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(docs, target, grams, buckets, percent=percent)


def test_ties_of_scores_are_ranked_by_id(frame):
    """Rows with few different scores: ranks of a score follow the ids, and the cutoff lies inside a score."""
    scored = frame([(k, None) for k in range(100)]).select(F.col("doc_id").alias("id"), F.lit(30).alias("n_words"), (F.col("doc_id") % 3).alias("score"))
    got = {r["id"]: r["rank"] for r in importance_resampling.draw(scored, percent=50).collect()}
    order = sorted(range(100), key=lambda k: (-(k % 3), k))
    assert got == {k: rank if rank <= 50 else None for rank, k in enumerate(order, 1)}


def test_crc_of_words_of_any_length():
    words = ["a", "b" * 63, "c" * 64, "d" * 5_000, "é" * 40]
    _, many, found = importance_resampling.hashed_features(pa.array([" ".join(words), None, ""]), 1, 1 << 31)
    assert many.tolist() == [5, 0, 0] and found.tolist() == [zlib.crc32(w.encode()) % (1 << 31) for w in words]


def test_gains_are_zero_where_rates_are_equal():
    assert not importance_resampling.gains(np.zeros(8, np.int64), np.zeros(8, np.int64)).any()


def brute_groups(rows):
    normal = lambda t: re.sub("[ \t\n\v\f\r]+", " ", t or "")
    size, first = Counter(normal(t) for _, t in rows), {}
    for k, t in rows:
        best = first.get(normal(t))
        first[normal(t)] = k if best is None else best if k is None else min(k, best)
    return sorted(((k, first[normal(t)], size[normal(t)]) for k, t in rows), key=str), Counter((first[normal(t)], normal(t)) for t in {normal(t): t for _, t in rows}.values())


def check_groups(df, rows, **how):
    got = exact_dedup.groups(df, carry=["text", "kept", "source"], **how)
    assert got.columns == ["doc_id", "text", "source", "keep_id", "group_size", "kept"]
    got = got.collect()
    want, stay = brute_groups(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want
    # one row of each text stays, and it has the smallest id
    assert Counter((r.doc_id, re.sub("[ \t\n\v\f\r]+", " ", r.text or "")) for r in got if r.kept) == stay


ALIKE = "the same three hundred characters of a beginning " * 8


@pytest.mark.parametrize("how", [{}, {"screen_bits": 1}, {"prefix_chars": 1}])
def test_exact_groups(frame, odd, how):
    rnd = random.Random(3)
    rows = [(k, rnd.choice(["a b", "a  b", "a\tb", " a b", "b a", "ab", "a b ", "é b", "A b", ALIKE + "x", ALIKE + "y", ALIKE + "\n\nx"])) for k in range(80)]
    rows += odd + [(None, "a b"), (None, "z"), (None, "z"), (200, "only here"), (5, "a b"), (5, "a b"), (-3, "b\va"), (9, "a b"), (8, "a b")]
    rnd.shuffle(rows)
    check_groups(frame(rows, kept="clash", keep_id=1, _length="x").repartition(5), rows, **how)


def test_one_group_of_many(frame):
    rows = [(k, "w " * 40) for k in range(500)] + [(k, f"w{k}") for k in range(500, 700)]
    check_groups(frame(rows, kept=0).repartition(7), rows)


def test_deduplicate_keeps_whole_rows(spark, frame):
    docs = frame([(3, "a  b"), (1, "a b"), (1, "a b"), (2, "c"), (4, None), (5, "")], keep_id="clash", kept="clash")
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.keep_id) for r in got.collect()) == [(1, "a b", "clash"), (2, "c", "clash"), (4, None, "clash")]
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_rows_with_a_text_of_their_own_are_not_hashed(frame, monkeypatch):
    """Only what the length and the beginning leave open gets a full hash."""
    written = {}
    real = exact_dedup.materialize
    monkeypatch.setattr(exact_dedup, "materialize", lambda df, name, **o: written.setdefault(name, real(df, name, **o)))
    docs = frame([(1, "a"), (2, "bb"), (3, "cc"), (4, ALIKE + "1"), (5, ALIKE + "2"), (6, "ddd"), (7, "ddd")])
    exact_dedup.groups(docs).count()
    assert sorted(r.doc_id for r in written["hashed"].where("_full is not null").collect()) == [4, 5, 6, 7]
