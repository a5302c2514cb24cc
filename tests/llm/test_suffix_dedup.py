import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import suffix_dedup as op
from tickloom.llm.kernels import U64


def brute(rows, length):
    seen, out = set(), []
    for k, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            x = data[s : s + length]
            if x in seen:
                gone[s : s + length] = True
            seen.add(x)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((k, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    out += [(None, len((t or "").encode()), 0, 0, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows if k is None]
    return sorted(out, key=str)


def passages(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcé ") for _ in range(rnd.randint(2, 9)))
    shared = ["".join(word() for _ in range(rnd.randint(10, 60))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [rnd.choice(shared)[rnd.randint(0, 30) :] if rnd.random() < 0.4 else word() for _ in range(rnd.randint(1, 30))]
        rows.append((k, "".join(parts)))
    return rows + [(n, "ab" * 300), (n + 1, "ab" * 200), (n + 2, "z" * 500)]


def check(frame, rows, **options):
    got = op.repeats(frame(rows), **options).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows, options.get("length", 100))


def test_matches_brute_force(frame):
    check(frame, passages(1, 60))


def test_hot_grams_take_the_other_way(frame):
    check(frame, passages(2, 60), hot_runs=2)


def test_equal_rows_of_multikey_quicksort():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        n, depth = int(rnd.integers(0, 200)), int(rnd.integers(1, 5))
        table, group = rnd.integers(0, 4, (n, depth)), rnd.integers(0, 5, n)
        size = 1 + group % depth if n else group
        rows, found = op.multikey_groups(lambda r, d: table[r, d].astype(U64), group, size)  # noqa: B023
        key = [(g, *table[i, : size[i]]) for i, g in enumerate(group)]
        expected = {k: {i for i in range(n) if key[i] == k} for k in key}
        got = {}
        for r, g in zip(rows.tolist(), found.tolist(), strict=True):
            got.setdefault(g, set()).add(r)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)


def test_many_small_batches_and_ranges(spark, frame, monkeypatch):
    """Settling inside batches, single starts in parts, and splitters change nothing."""
    for name, value in (("RUNS_AT_ONCE", 50), ("STARTS_AT_ONCE", 37), ("SORTED_AT_ONCE", 500), ("SORTED_STARTS", 30), ("ONE_IN", 1), ("BUCKET_BYTES", 100), ("MOST_RANGES", 5)):
        monkeypatch.setattr(op, name, value)
    rows = passages(5, 40)
    check(frame, rows)
    check(frame, rows, hot_runs=1)
    docs = frame(rows).select("doc_id", "text")
    splitters, parts = op.splitters_of(op.repeated_grams(op.gram_rows(docs, 7, 100, 32)), 100)
    assert len(splitters) > 2 and len(parts) == len(splitters) + 1 and parts.min() > 2


def test_a_common_heading_has_many_buckets(spark, frame, monkeypatch):
    """Grams that begin in a heading share their leading bytes; their range is dealt to as many buckets as it is quantiles."""
    monkeypatch.setattr(op, "ONE_IN", 1)
    monkeypatch.setattr(op, "LEAST_BUCKETS", 1000)
    rnd = random.Random(11)
    own = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    heading, tails = own(40), [own(100) for _ in range(800)]
    rows = [(k, heading + tails[k // 2] + own(30)) for k in range(1600)]
    docs = frame(rows).select("doc_id", "text")
    runs = op.repeated_grams(op.gram_rows(docs, 7, 100, 32))
    splitters, parts = op.splitters_of(runs, 100)
    places = runs.groupBy("doc_id").agg(F.collect_list("place").alias("runs")).withColumn("hot", F.array().cast("array<bigint>"))
    texts = docs.join(places, "doc_id").select("doc_id", "text", "runs", "hot")

    def largest(parts):
        sent = op.send_runs(texts, splitters, parts, 100, 32).where("not settled")
        return sent.groupBy("bucket").agg(F.sum("rows").alias("n")).agg(F.max("n")).first()[0]

    assert parts.max() > 5 and 2 * largest(parts) < largest(np.ones_like(parts))
    check(frame, rows)


@pytest.mark.parametrize(("length", "gram"), [(159, 32), (160, 32), (300, 32), (500, 32), (64, 64), (40, 8)])
def test_other_lengths(frame, length, gram):
    text = "".join(random.Random(9).choice("abcdefgh ") for _ in range(900))
    rows = [*passages(6, 25), (100, text), (101, "x" + text[:600] + "y"), (102, text[100:])]
    check(frame, rows, length=length, gram=gram)


def test_lengths_out_of_range_are_refused(frame):
    for length, gram in ((20, 32), (100, 7), (70_000, 32)):
        with pytest.raises(ValueError, match="gram"):
            op.repeats(frame([]), length=length, gram=gram)


def test_one_hot_gram_around_unlike_bytes(frame):
    """A phrase with the smallest hash of all texts, each with bytes of its own around it."""
    rnd = random.Random(8)
    own = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    passage = own(140)
    rows = [(k, own(90) + passage + own(90)) for k in range(150)]
    check(frame, rows, hot_runs=20)
    check(frame, rows)


def test_split_buffers_change_nothing(frame, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 700)
    rows = passages(3, 10)
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    runs = op.anchor_runs(data, np.array([0, len(data)]), 100, 32)
    assert (runs[4] - runs[3] + 1).sum() == len(data) - 99


def test_short_strings(frame):
    check(frame, passages(4, 30), length=40, gram=16)


def test_edge_cases(frame, odd):
    check(frame, odd)


def test_repeated_ids(frame):
    rows = [(1, "x" * 40 + "passage " * 30), (1, "passage " * 30), (1, "passage " * 30), (2, "tail passage " * 20)]
    check(frame, rows)


def test_empty_table_and_cut(frame):
    assert op.repeats(frame([])).count() == 0
    text = "é" * 30 + " a passage that many documents share and that is longer than a hundred bytes in all of them, surely so. " * 2
    rows = frame([(1, text), (2, "own start. " + text), (3, None)], suffix_key="clash", removed_spans="clash", _spans="clash", spans=1, key="k")
    out = op.cut(rows)
    assert out.columns == [c for c in rows.columns]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1].startswith("é" * 30) and got[2].startswith("own start. ") and len(got[2]) < 20 and got[3] is None
