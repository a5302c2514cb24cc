"""Toxicity: cumulative-link ordinal regression over sparse text features.

The model is logit P(grade >= k) = w . x - theta_k with increasing thresholds theta and one weight vector for all of them; the
expected severity is the sum of P(grade >= k) over k. Features are lower-cased words and their beginnings of 4 to 7 bytes, so
that inflected forms share evidence, with the logarithm of one plus their count.

Grades are labels: ``fit`` takes whole numbers from 0 on, as many as there are. Labels that are flags hold two grades and no
severities: ``flagged`` makes 0 and 1 of them, so that there is one threshold and the expected severity is the probability of
the flag. No third grade is made up from other columns: low quality is not severity, and a model that must put toxic documents of low
quality above the others loses a fifth of all toxic ones.

Fitting uses at most MAX_LABELLED labelled documents, those with the smallest hashes of doc_id; this bound is fixed, so what
is fitted on the driver is bounded too. Features of LEAST_DOCS documents are screened by a weak test of independence from toxicity,
of either sign (LEAST_Z deviations), and weighted under an L1 penalty that leaves out those that add nothing. Scoring is one pass over whole
texts without a shuffle.

Edge cases: NULL and empty texts have no features and get the severity of the thresholds alone; without labels of two grades
the model is empty, every severity is 0 and nothing is toxic; repeated rows are scored one by one, and one row of a
repeated doc_id, the same whatever the order, is fitted; extra columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import spread, table
from tickloom.llm.kernels import FOLD, U64, Rolling, slices, text_bytes

MAX_LABELLED = 20_000
PREFIXES = (4, 5, 6, 7)
#: Deviations from independence that a feature's count among toxic documents must show, upwards or downwards.
LEAST_Z = 2.0
#: Labelled documents that a feature must be in.
LEAST_DOCS = 2
#: p_toxic from which a document counts as toxic.
TOXIC_FROM = 0.5
#: Weight of the L1 penalty, in units of the log-likelihood of all rows.
PENALTY = 0.3
BYTES_AT_ONCE = 2_000_000
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, words per row): keys of all words and word beginnings of each row's text."""
    data = FOLD[data]
    letter = np.zeros(len(data) + 1, bool)
    letter[:-1] = LETTER[data]
    opens, ends = letter[:-1].copy(), letter[:-1].copy()
    opens[1:] &= ~letter[:-2]
    ends &= ~letter[1:]
    inner = offsets[1:-1][(offsets[1:-1] < len(data)) & (offsets[1:-1] > 0)]
    opens[inner] |= letter[inner]
    ends[inner - 1] |= letter[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(ends) + 1
    rows = np.searchsorted(offsets, start, side="right") - 1
    rolling = Rolling(data)
    keys, owner = [rolling.hash(start, end)], [rows]
    for n in PREFIXES:
        long = end - start > n
        keys.append(rolling.hash(start[long], start[long] + n) ^ U64(0x5851F42D4C957F2D))
        owner.append(rows[long])
    return np.concatenate(keys), np.concatenate(owner), np.bincount(rows, minlength=len(offsets) - 1)


@dataclass(frozen=True)
class OrdinalModel:
    """keys sorted; one weight for each; thresholds increasing."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, count, words per row), only of the model's features."""
        key, row, words = features(data, offsets)
        if not len(self.keys) or not len(key):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), words
        seen = np.zeros(1 << 18, bool)
        seen[(self.keys & U64((1 << 18) - 1)).astype(np.int64)] = True
        maybe = seen[(key & U64((1 << 18) - 1)).astype(np.int64)]
        key, row = key[maybe], row[maybe]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        pair, count = np.unique(row[hit] * len(self.keys) + at[hit], return_counts=True)
        return pair // len(self.keys), pair % len(self.keys), count, words

    def exceed(self, row: np.ndarray, feature: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= k) for each row and k = 1, 2, ..."""
        if not len(self.thresholds):  # an empty model
            return np.zeros((n, 1))
        score = np.bincount(row, weights=self.weights[feature] * np.log1p(count), minlength=n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def likelihood(p: np.ndarray, row, feature, x, grade: np.ndarray, n_features: int) -> tuple[float, np.ndarray]:
    """Mean log-likelihood of the grades and its gradient by p: weights, the first threshold, logarithms of the gaps between them.

    x are the values of the sparse features, so thresholds are the first one plus positive gaps and stay in order.
    """
    n, index = len(grade), np.arange(len(grade))
    gaps = np.exp(p[n_features + 1 :])
    theta = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
    score = np.bincount(row, weights=p[feature] * x, minlength=n)
    above = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -40, 40)))
    edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
    prob = np.maximum(edges[index, grade] - edges[index, grade + 1], 1e-12)
    slope = edges * (1 - edges)
    d_score = (slope[index, grade] - slope[index, grade + 1]) / prob
    d_theta = np.zeros((n, len(theta) + 2))
    d_theta[index, grade] -= slope[index, grade] / prob
    d_theta[index, grade + 1] += slope[index, grade + 1] / prob
    d_theta = d_theta[:, 1:-1].sum(0)
    d_weights = np.bincount(feature, weights=d_score[row] * x, minlength=n_features)
    d_gaps = d_theta[::-1].cumsum()[::-1][1:] * gaps
    return float(np.log(prob).mean()), np.concatenate([d_weights, [d_theta.sum()], d_gaps]) / n


def fit_ordinal(row, feature, count, grade: np.ndarray, n_features: int, steps: int = 600, rate: float = 0.05, penalty: float = PENALTY):
    """Weights and thresholds of the largest likelihood less the L1 penalty, by proximal Adam steps over all rows."""
    x, top = np.log1p(count), int(grade.max())
    at_least = np.stack([(grade >= k).mean() for k in range(1, top + 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.log((1 - at_least) / at_least)
    p = np.concatenate([np.zeros(n_features), [theta[0]], np.log(np.maximum(np.diff(theta), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        _, grad = likelihood(p, row, feature, x, grade, n_features)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        pace = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        p = p + pace * m / (1 - 0.9**step)
        w, shrink = p[:n_features], pace[:n_features] * penalty / len(grade)
        p[:n_features] = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


EMPTY = OrdinalModel(np.zeros(0, U64), np.zeros(0), np.zeros(0))


def flagged(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from flags(doc_id, toxic): 1 for toxic, 0 for not; rows without a flag are no labels."""
    return labels.where("toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("grade"))


def fit(docs: DataFrame, grades: DataFrame) -> OrdinalModel:
    """Fit on grades(doc_id, grade 0, 1, ...) of docs(doc_id, text); the highest grade of a doc_id holds."""
    known = grades.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def document_counts(batches):
        for batch in batches:
            for part in slices(batch, "text", BYTES_AT_ONCE):
                key, row, _ = features(*text_bytes(part.column("text")))
                key, row = (x[0] for x in np.split(np.unique(np.stack([key, row.astype(U64)]), axis=1), 2)) if len(key) else (key, row)
                toxic = np.array(part.column("grade").to_pylist(), np.int64) > 0
                found, place = np.unique(key, return_inverse=True)
                n1 = np.bincount(place, weights=toxic[row.astype(np.int64)], minlength=len(found)).astype(np.int64)
                n = np.bincount(place, minlength=len(found))
                # the row without a key counts documents
                arrays = pa.array([*found.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n1, toxic.sum())), pa.array(np.append(n, part.num_rows))
                yield pa.RecordBatch.from_arrays([*arrays], ["key", "n1", "n"])

    counted = rows.mapInArrow(document_counts, "key bigint, n1 bigint, n bigint").groupBy("key").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    total = counted.where("key is null").select(F.col("n1").alias("toxic"), F.col("n").alias("docs"))
    share = F.col("toxic") / F.col("docs")
    z = (F.col("n1") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    chosen = counted.where("key is not null").crossJoin(F.broadcast(total.where("0 < n1 and n1 < n"))).where((F.col("n") >= LEAST_DOCS) & (F.abs(z) >= LEAST_Z))
    keys = np.sort(np.array([r["key"] for r in chosen.select("key").collect()], np.int64).view(U64))
    if not len(keys):
        return EMPTY
    picker = OrdinalModel(keys, np.zeros(len(keys)), np.zeros(0))

    def sparse(batches):
        for batch in batches:
            for part in slices(batch, "text", BYTES_AT_ONCE):
                row, feature, count, _ = picker.counts(*text_bytes(part.column("text")))
                cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (feature, count)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), *lists], ["doc_id", "grade", "feature", "count"])

    got = rows.select("doc_id", "text", "grade").mapInArrow(sparse, "doc_id bigint, grade int, feature array<int>, count array<int>")
    # one row a document, so that repeated rows do not pass the bound
    got = got.groupBy("doc_id").agg(F.min(F.struct("grade", "feature", "count")).alias("x")).select("doc_id", "x.*").toArrow().sort_by("doc_id")
    sizes = np.array(got["feature"].combine_chunks().value_lengths())
    feature, count = (np.array(got[c].combine_chunks().flatten()) for c in ("feature", "count"))
    weights, thresholds = fit_ordinal(np.repeat(np.arange(len(sizes)), sizes), feature, count, np.array(got["grade"], np.int64), len(keys))
    used = weights != 0
    return OrdinalModel(keys[used], weights[used], thresholds)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """Adds severity (expected grade), p_toxic (that of grade 1 or more) and toxic (p_toxic of ``toxic_from`` or more)."""
    out = ("severity", "p_toxic", "toxic")
    rest = docs.drop(*out)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, BYTES_AT_ONCE):
                row, feature, count, _ = model.counts(*text_bytes(part.column(text_col)))
                above = model.exceed(row, feature, count, part.num_rows)
                arrays = [pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= toxic_from)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "severity double", "p_toxic double", "toxic boolean"])
    return rest.mapInArrow(run, schema)


def query(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return score(docs, fit(docs, flagged(table(spark, sf_dir, "labels")))).drop("text")
