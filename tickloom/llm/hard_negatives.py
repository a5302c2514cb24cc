"""Hard-negative mining by orthogonal rotation: leading components first, the rest bounded, survivors verified with integers.

Vectors become integers, floor(scale * x). An orthogonal matrix, the principal axes of a bounded sample, rotates them, which
leaves inner products as they are and puts most of them into the leading components. For anchors and rows of a block:

1. Partial products of the leading components are accumulated, one slice of components after another.
2. What the other components can add is at most the product of the two residual norms (Cauchy-Schwarz); with slack for
   the rounding of doubles and for how far the matrix is from orthogonal, a score lies within that of its partial product.
3. A pair whose bound is below what its anchor has already found, or outside every window it wants, is discarded.
4. Survivors get their integer inner product, and only that decides.

Anchors (rows whose id is divisible by ``every``) are a stated query set: blocks of them meet blocks of all rows, each pair of
blocks in a group of bounded size, and each group returns a few rows for an anchor. The work is that of the exact question,
anchors times rows; the matrix steers how much of it is cut off, never the result. Positives come first, then the windows
that follow from their scores.

Defined cases: rows with a NULL label, a NULL vector, or a NULL or non-finite component take no part. A NULL id is no anchor and comes
after all others in a tie. Rows that repeat are rows of their own: copies of an anchor are among its positives, and each copy of an
anchor has its own. Of more copies of a vector with one label than can be returned, only those with the smallest ids are compared.
A vector that is shorter than the longest one counts as padded with zeros, an empty one as zeros. An integer vector longer than
2**26 is an error, since its scores don't fit 64 bits a hundredfold. Anchors without positives, and positives without rows in their window,
give no rows. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, table

SCALE, EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
#: Rows that the rotation is fitted on, about; twice as many at most.
FIT_ROWS = 4_096
#: Bytes of a block's vectors, and the least number of blocks that all rows are dealt to.
BLOCK_BYTES, LEAST_BLOCKS = 1 << 24, 32
#: Anchors and rows whose products are in memory at a time, slices of components, and pairs verified at a time.
ANCHORS_AT_ONCE, ROWS_AT_ONCE, SLICES, PAIRS_AT_ONCE = 256, 4_096, 4, 1 << 16
#: Share of pairs from which on a slice is cheaper for all pairs than an integer product for each survivor.
DENSE = 0.02
LONGEST = 2.0**26
PAIR = "anchor bigint, anchor_id bigint, row bigint, row_id bigint, score bigint"
WINDOW = "anchor bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, row bigint, row_id bigint, score bigint"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(row, id, label, q): the rows that take part, numbered, with their integer components."""
    value = F.col("v")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taking = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    taking = taking.where(F.col("label").isNotNull() & value.isNotNull() & finite)
    q = F.transform(value, lambda x: F.floor(x * float(scale)))
    length = F.aggregate(F.col("q"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = taking.select("id", "label", q.alias("q"))
    fits = F.when(length <= LONGEST**2, F.col("q").cast("array<int>")).otherwise(F.raise_error(F.lit(f"an integer vector is longer than {LONGEST:.0f}")))
    return whole.select(F.monotonically_increasing_id().alias("row"), "id", "label", fits.alias("q"))


def rotation(vectors: DataFrame, n: int, dims: int, rows: int = FIT_ROWS) -> np.ndarray:
    """An orthogonal matrix whose leading columns are the principal axes of a sample of about ``rows`` rows.

    Inner products are about the origin, so the axes are too.
    """
    some = vectors.select("q").sample(min(1.0, rows / max(n, 1)), seed=7).limit(2 * rows).toArrow()
    x = _matrix(some.column("q"), dims).astype(np.float64)
    _, axes = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(axes[:, ::-1])


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """The integer vectors as rows of a matrix, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dims), np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.arange(dims) < lengths[:, None]] = column.flatten().to_numpy()
    return out


class Side:
    """Vectors of one side: integers, rotated components, and the norm of what is left behind each slice."""

    def __init__(self, part: pa.Table, axes: np.ndarray, order: bool = False):
        dims = len(axes)
        self.row, self.label = part.column("row").to_numpy(), part.column("label").to_numpy()
        self.id = part.column("id").combine_chunks()
        q = _matrix(part.column("q"), dims)
        if order:
            last = self.id.is_null().to_numpy(zero_copy_only=False)
            at = np.lexsort((self.row, self.id.fill_null(0).to_numpy(), last))
            self.row, self.label, self.id, q = self.row[at], self.label[at], self.id.take(pa.array(at)), q[at]
        self.q = q
        self.cuts = np.unique(np.linspace(0, dims, SLICES + 1).astype(int))
        self.turned = q.astype(np.float64) @ axes
        squares = np.concatenate([np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1))], axis=1)
        self.rest = np.sqrt(squares)[:, self.cuts]
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))

    def take(self, at: np.ndarray | slice) -> Side:
        out = object.__new__(Side)
        out.cuts = self.cuts
        for name in ("row", "label", "q", "turned", "rest", "norm"):
            setattr(out, name, getattr(self, name)[at])
        out.id = self.id.take(pa.array(np.arange(len(self.row))[at]))
        return out


def first_copies(side: Side, most: int) -> Side:
    """The rows (in order of id) but for copies of a vector with its label beyond the first ``most``."""
    if not len(side.row):
        return side
    key = np.ascontiguousarray(np.column_stack([side.label, side.q]))
    _, same = np.unique(key.view(f"V{key.shape[1] * 8}").ravel(), return_inverse=True)
    at = np.argsort(same, kind="stable")
    start = np.searchsorted(same[at], same[at])
    return side.take(np.sort(at[np.arange(len(at)) - start < most]))


def leaders(group: np.ndarray, score: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first ``most`` of each group: higher scores, then smaller places."""
    at = np.lexsort((place, -score, group))
    start = np.searchsorted(group[at], group[at])
    return at[np.arange(len(at)) - start < most]


def partial_products(a: Side, b: Side, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(products, margin, last): after each slice, every score lies within the margin of its product."""
    products = np.zeros((len(a.row), len(b.row)))
    rounding = slack * a.norm[:, None] * b.norm[None, :]
    for k, (low, high) in enumerate(zip(a.cuts[:-1], a.cuts[1:], strict=True), 1):
        products += a.turned[:, low:high] @ b.turned[:, low:high].T
        yield products, a.rest[:, k][:, None] * b.rest[:, k][None, :] + rounding, k == len(a.cuts) - 1


def verified(a: Side, b: Side, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor index, row index, integer score) of the pairs that are alive."""
    i, j = np.nonzero(alive)
    out = np.zeros(len(i), np.int64)
    for k in range(0, len(i), PAIRS_AT_ONCE):
        some = slice(k, k + PAIRS_AT_ONCE)
        out[some] = np.einsum("ij,ij->i", a.q[i[some]], b.q[j[some]])
    return i, j, out


def nth_largest(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row, -inf if there are fewer."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - n, axis=1)[:, values.shape[1] - n]


def _tiles(n: int, size: int) -> Iterator[slice]:
    for k in range(0, n, size):
        yield slice(k, k + size)


def nearest_alike(anchors: Side, rows: Side, most: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor index, row index, score): the first ``most`` other rows of the same label for each anchor."""
    found = []
    for label in np.unique(anchors.label):
        mine, theirs = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        for at in _tiles(len(mine), ANCHORS_AT_ONCE):
            a = anchors.take(mine[at])
            best, least = (np.zeros(0, np.int64),) * 3, np.full(len(a.row), -np.inf)
            for to in _tiles(len(theirs), ROWS_AT_ONCE):
                b = rows.take(theirs[to])
                alive = a.row[:, None] != b.row[None, :]
                for products, margin, last in partial_products(a, b, slack):
                    sure = nth_largest(np.where(alive, products - margin, -np.inf), most)
                    least = np.maximum(least, sure)
                    alive &= products + margin >= least[:, None]
                    if last or alive.mean() < DENSE:
                        break
                i, j, s = verified(a, b, alive)
                best = tuple(np.concatenate(x) for x in zip(best, (i, theirs[to][j], s), strict=True))
                best = tuple(x[leaders(best[0], best[2], best[1], most)] for x in best)
                i, s = best[0], best[2]
                full = np.bincount(i, minlength=len(a.row)) >= most
                low = np.full(len(a.row), np.iinfo(np.int64).max)
                np.minimum.at(low, i, s)
                least = np.where(full, np.maximum(least, low), least)
            found.append((mine[at][best[0]], best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def nearest_in_windows(anchors: Side, rows: Side, low: np.ndarray, high: np.ndarray, most: int, slack: float) -> tuple[np.ndarray, ...]:
    """(anchor index, window, row index, score): the first ``most`` rows of other labels with low <= score <= high, for each window.

    ``low`` and ``high`` have a row for each anchor and a column for each window; an empty window has low > high.
    """
    found = []
    for at in _tiles(len(anchors.row), ANCHORS_AT_ONCE):
        a, lows, highs = anchors.take(at), low[at], high[at]
        windows = lows.shape[1]
        least = lows.astype(np.float64)
        best = (np.zeros(0, np.int64),) * 3
        for to in _tiles(len(rows.row), ROWS_AT_ONCE):
            b = rows.take(to)
            alive = a.label[:, None] != b.label[None, :]
            for products, margin, last in partial_products(a, b, slack):
                floor, ceiling = products - margin, products + margin
                before, alive = alive, np.zeros(alive.shape, bool)
                for w in range(windows):
                    if last:
                        inside = before & (floor >= lows[:, w, None]) & (ceiling <= highs[:, w, None])
                        least[:, w] = np.maximum(least[:, w], nth_largest(np.where(inside, floor, -np.inf), most))
                    alive |= before & (ceiling >= least[:, w, None]) & (floor <= highs[:, w, None])
                if last or alive.mean() < DENSE:
                    break
            i, j, s = verified(a, b, alive)
            pick, w = np.nonzero((s[:, None] >= lows[i]) & (s[:, None] <= highs[i]))
            best = tuple(np.concatenate(x) for x in zip(best, (i[pick] * windows + w, np.arange(len(rows.row))[to][j[pick]], s[pick]), strict=True))
            best = tuple(x[leaders(best[0], best[2], best[1], most)] for x in best)
            full = np.bincount(best[0], minlength=least.size) >= most
            lowest = np.full(least.size, np.iinfo(np.int64).max)
            np.minimum.at(lowest, best[0], best[2])
            least = np.where(full.reshape(least.shape), np.maximum(least, lowest.reshape(least.shape)), least)
        found.append((np.arange(len(anchors.row))[at][best[0] // windows], best[0] % windows, best[1], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def mine(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = SCALE, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    ``low`` and ``high`` are percent of the positive's score, both included.
    """
    vectors = materialize(integer_vectors(df, id_col, vector_col, F.col("label") if label is None else label, scale), "vectors")
    anchor = F.pmod("id", F.lit(every)) == 0
    n, anchors, dims = vectors.agg(F.count("*"), F.count(F.when(anchor, 1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    dims = max(dims, 1)
    axes = rotation(vectors, n, dims)
    # the matrix's distance from orthogonal, and rounding of its products and of partial products
    slack = float(np.linalg.norm(axes @ axes.T - np.eye(dims))) + 16 * dims**1.5 * np.finfo(np.float64).eps
    per_block = max(1_024, BLOCK_BYTES // (8 * dims))
    row_blocks, anchor_blocks = max(LEAST_BLOCKS, -(-n // per_block)), max(1, -(-anchors // per_block))
    block = ["anchor_block", "row_block"]

    def dealt(side: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return side.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    rows = dealt(vectors, "row_block", row_blocks, "anchor_block", anchor_blocks).groupBy(*block)
    asked = dealt(vectors.where(anchor).toDF(*vectors.columns), "anchor_block", anchor_blocks, "row_block", row_blocks)

    def alike(theirs: pa.Table, ours: pa.Table) -> pa.Table:
        a, b = Side(ours, axes), first_copies(Side(theirs, axes, order=True), positives + 1)
        i, j, s = nearest_alike(a, b, positives, slack)
        return pa.table([pa.array(a.row[i]), a.id.take(pa.array(i)), pa.array(b.row[j]), b.id.take(pa.array(j)), pa.array(s)], ["anchor", "anchor_id", "row", "row_id", "score"])

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("row_id").asc_nulls_last(), "row")
    near = rows.cogroup(asked.groupBy(*block)).applyInArrow(alike, PAIR)
    near = materialize(near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")

    def within(theirs: pa.Table, ours: pa.Table) -> pa.Table:
        a, b = Side(ours, axes), first_copies(Side(theirs, axes, order=True), negatives)
        wanted = ours.column("wanted").combine_chunks()
        many = wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        each = wanted.flatten()
        given = np.arange(positives) < many[:, None]
        scores, place, positive = np.zeros(given.shape, np.int64), np.zeros(given.shape, np.int32), np.zeros(given.shape, np.int64)
        scores[given], place[given], positive[given] = each.field("score").to_numpy(), each.field("place").to_numpy(), np.arange(len(each))
        # ceil(low * score / 100) and floor(high * score / 100), empty for negative scores
        lows = np.where(given, -(-low * scores // 100), 1)
        highs = np.where(given, high * scores // 100, 0)
        i, w, j, s = nearest_in_windows(a, b, lows, highs, negatives, slack)
        out = [pa.array(a.row[i]), a.id.take(pa.array(i)), pa.array(place[i, w]), each.field("row_id").take(pa.array(positive[i, w])), pa.array(scores[i, w]), pa.array(b.row[j]), b.id.take(pa.array(j)), pa.array(s)]
        return pa.table(out, ["anchor", "anchor_id", "place", "positive_id", "positive_score", "row", "row_id", "score"])

    wanted = near.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", "row_id", "score"))).alias("wanted"))
    windowed = asked.join(wanted, "row").toDF(*asked.columns, "wanted")
    hard = rows.cogroup(windowed.groupBy(*block)).applyInArrow(within, WINDOW)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.col("row_id").asc_nulls_last(), "row")
    out = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir):
    label = F.col("label").cast("long")
    return mine(table(spark, sf_dir, "embeddings"), label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


SQL = """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
    SELECT a.u, a.vec_id AS anchor_id, b.u AS o, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.u <> b.u
), pos AS (
    SELECT * FROM p WHERE alike QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, id NULLS LAST, o) <= 5
), neg AS (
    SELECT pos.anchor_id, pos.id AS positive_id, n.id AS negative_id, pos.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY pos.u, pos.o ORDER BY n.score DESC, n.id NULLS LAST, n.o) AS rank
    FROM pos JOIN p n ON n.u = pos.u AND NOT n.alike AND 50 * pos.score <= 100 * n.score AND 100 * n.score <= 95 * pos.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
