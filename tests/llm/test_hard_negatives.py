import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import hard_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, positive_id int"
NAN, INF = float("nan"), float("inf")


def taking(rows):
    """(row number, id, label, integers) of the rows that take part, vectors padded with zeros."""
    good = [(k, i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for k, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for *_, v in good), default=0)
    return [(k, i, y, v + [0] * (dims - len(v))) for k, i, y, v in good]


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    good, out = taking(rows), []
    for k, i, y, v in good:
        if i is None or i % every:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, z) for n, j, z, w in good if n != k)
        for s, none, j, _ in [r for r in ranked if r[3] == y][:positives]:
            inside = [r for r in ranked if r[3] != y and low * -s <= 100 * -r[0] <= high * -s]
            out += [(i, None if none else j, rank, None if r[1] else r[2], -s, -r[0]) for rank, r in enumerate(inside[:negatives], 1)]
    return sorted(out, key=str)


def vectors(seed, n, dims, copies=0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rnd.choice(centres)
        rows.append((i, [x + rnd.gauss(0, 0.7) for x in c], rnd.choice([0, 1, 2])))
    rows += [(n + i, rows[3][1], 1) for i in range(copies)]
    rnd.shuffle(rows)
    return rows


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA).repartition(3)
    got = op.mine(df, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize(("dims", "copies"), [(6, 0), (3, 150), (1, 0)])
def test_equals_brute_force(spark, dims, copies):
    rows = vectors(dims, 220, dims, copies)
    got = mined(spark, rows, every=10)
    assert got and got == brute(rows, every=10)


def test_blocks_of_anchors_and_rows(spark, monkeypatch):
    monkeypatch.setattr(op, "LEAST_BLOCKS", 3)
    monkeypatch.setattr(op, "BLOCK_BYTES", 0)
    rows = [(i % 1_300, v, y) for i, v, y in vectors(5, 1_400, 2)]
    got = mined(spark, rows, every=1, positives=2, negatives=2)  # two blocks of anchors: more than 1,024
    assert got == brute(rows, every=1, positives=2, negatives=2)


def test_odd_rows(spark):
    rows = vectors(8, 60, 3)
    rows += [(100, None, 1), (150, [1.0, None, 1.0], 1), (200, [NAN, 1.0, 1.0], 1), (250, [INF, 0.0, 0.0], 1), (300, [1.0, 1.0, 1.0], None)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 2), (350, [], 1), (400, [2.0], 0), (0, rows[5][1], rows[5][2]), rows[7], rows[7], (-50, [1.5, 0.5, -0.5], 2)]
    got = mined(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} <= {0, 50, 350, 400, -50}
    assert not mined(spark, [(0, [1.0], 1), (1, [1.0], 1)])  # no rows of another label
    assert not mined(spark, [(0, [1.0], 1), (1, [1.0], 2)])  # no positives
    assert not mined(spark, [])


def test_vectors_beyond_the_range_are_an_error(spark):
    with pytest.raises(Exception, match="integer vector is longer"):
        mined(spark, [(0, [1e9], 1), (1, [1.0], 1)])


def side(rows, axes):
    t = pa.table({"row": pa.array([r[0] for r in rows], pa.int64()), "id": pa.array([r[1] for r in rows], pa.int64()), "label": pa.array([r[2] for r in rows], pa.int64()), "q": pa.array([r[3] for r in rows], pa.list_(pa.int32()))})
    return op.Side(t, axes, order=True)


@pytest.mark.parametrize("axes", [np.eye(5), np.linalg.qr(np.random.default_rng(1).normal(size=(5, 5)))[0]])
def test_scores_lie_within_the_margins_and_any_rotation_gives_the_result(monkeypatch, axes):
    """Tiles of a few rows, with and without the way over dense slices."""
    monkeypatch.setattr(op, "ANCHORS_AT_ONCE", 7)
    monkeypatch.setattr(op, "ROWS_AT_ONCE", 11)
    monkeypatch.setattr(op, "PAIRS_AT_ONCE", 5)
    rows = side(taking(vectors(3, 90, 5, 20)), axes)
    exact = rows.q @ rows.q.T
    for products, margin, _ in op.partial_products(rows, rows, 1e-12):
        assert (np.abs(products - exact) <= margin).all()
    for dense in (0.0, 1.0):
        monkeypatch.setattr(op, "DENSE", dense)
        i, j, s = op.nearest_alike(rows, rows, 4, 1e-12)
        assert (s == exact[i, j]).all()
        for a in range(len(rows.row)):
            alike = [b for b in range(len(rows.row)) if rows.label[b] == rows.label[a] and b != a]
            assert sorted(j[i == a]) == sorted(sorted(alike, key=lambda b: (-exact[a, b], b))[:4])
        low, high = np.full((len(rows.row), 2), [[0, 300]]), np.full((len(rows.row), 2), [[400, 90_000]])
        i, w, j, s = op.nearest_in_windows(rows, rows, low, high, 2, 1e-12)
        for a in range(len(rows.row)):
            for k in range(2):
                inside = [b for b in range(len(rows.row)) if rows.label[b] != rows.label[a] and low[a, k] <= exact[a, b] <= high[a, k]]
                assert sorted(j[(i == a) & (w == k)]) == sorted(sorted(inside, key=lambda b: (-exact[a, b], b))[:2])


def test_leading_components_discard_most_pairs():
    """Vectors near a plane: after the first slice few pairs are alive."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 2)) @ rng.normal(size=(2, 32)) * 100 + rng.normal(size=(500, 32))
    rows = [(k, k, 0, v) for k, v in enumerate(np.floor(x).astype(int).tolist())]
    _, axes = np.linalg.eigh(x.T @ x)
    part = side(rows, np.ascontiguousarray(axes[:, ::-1]))
    products, margin, _ = next(op.partial_products(part, part, 1e-12))
    least = op.nth_largest(products - margin, 5)
    assert (products + margin >= least[:, None]).mean() < 0.05
