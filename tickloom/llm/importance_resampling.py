"""Importance resampling towards a target distribution, with array-scored weights and an exact histogram of integer scores.

Features are runs of words, hashed into buckets by CRC-32. A bucket's gain is the logarithm of its rate in the target over its
rate in the corpus, a document's weight the mean gain of its features, and its score the weight plus a Gumbel value drawn from a
hash of its id: the highest scores are a draw without replacement in proportion to the weights.

1. One pass over the texts keeps two bytes for each feature; the counts of each task meet per bucket, so the corpus sends a
   row a bucket and task to the shuffle whatever its texts.
2. Weights are sums over the array of gains, looked up by bucket.
3. Scores are integers, so their histogram is exact and bounded: a gain is less than 44,000 in size and a Gumbel value between
   -3,200 and 22,300. Summed from the top, it gives each score the number of rows ahead of it, and the cutoff where the draw is full.
4. Only rows at the cutoff or above are ranked, by id within each score: no sort of all rows, and no group but of one score.

Edge cases: NULL and blank texts have no features and weight 0; they are counted but too short to be drawn. A NULL id hashes
as an empty one and comes after all others in a tie. Rows that repeat are scored and drawn one by one; ties of id and score
get consecutive ranks. Without documents the result is empty; without target texts all rates of the target are equal. Very
long words and texts are hashed whole. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, release, spread, table
from tickloom.llm.kernels import FOLD, ranges, slices, text_bytes, word_spans

BUCKETS, GRAMS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
BYTES_AT_ONCE = 2_000_000
#: From this length on, words are hashed one by one.
LONG_WORD = 64
#: Bytes of words: digits, letters with A-Z folded, and all beyond ASCII; the others become blanks.
WORD = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    WORD[_low : _high + 1] = FOLD[_low : _high + 1]


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


CRC = _crc_table()


def _step(register: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return CRC[(register ^ byte) & 255] ^ (register >> np.uint32(8))


def extend(register: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC registers after the bytes data[start:end] of each word: one vector step per place in the words."""
    out, length = register.copy(), end - start
    for i in np.flatnonzero(length >= LONG_WORD).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]], int(~out[i])) ^ 0xFFFFFFFF
    live = np.flatnonzero(length < LONG_WORD)
    k = 0
    while True:
        live = live[length[live] > k]
        if not len(live):
            return out
        out[live] = _step(out[live], data[start[live] + k])
        k += 1


def hashed_features(column: pa.Array, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, features, bucket of each feature): the two counts of each row, and the features of one row after another."""
    data, offsets = text_bytes(column)
    data = WORD[data]
    start, end, first = word_spans(data, offsets)
    n = np.diff(first)
    features = sum(np.maximum(n - g, 0) for g in range(grams))
    out = np.zeros(int(features.sum()), np.uint32)
    to = np.cumsum(features) - features
    register = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for g in range(grams):
        many = np.maximum(n - g, 0)
        at = ranges(first[:-1], many)
        register[at] = extend(register[at] if not g else _step(register[at], 0x20), data, start[at + g], end[at + g])
        out[ranges(to, many)] = (~register[at]) % np.uint32(buckets)
        to = to + many
    return n, features, out


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets) of each row, the buckets packed."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BYTES_AT_ONCE):
                n, many, found = hashed_features(part.column("text"), grams, buckets)
                edges = np.concatenate([[0], np.cumsum(many)]) * np.dtype(kind).itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(found.astype(kind))])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(many), packed.cast(pa.binary())], ["id", "n_words", "n_features", "buckets"])

    plain = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "id bigint, n_words bigint, n_features bigint, buckets binary")


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    packed = column.cast(pa.large_binary())
    data, edges = packed.buffers()[2], np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1, packed.offset * 8)
    return np.frombuffer(data, kind, (edges[-1] - edges[0]) // np.dtype(kind).itemsize, edges[0]) if data is not None and data.size else np.zeros(0, kind)


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket. Every task sends its sums; the driver gets a row a bucket."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column("buckets"), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    sums = found.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1,000 times the logarithm of each bucket's smoothed rate in the target over that in the corpus, floored."""
    m = float(len(corpus))
    rate = (target + 1.0) * (float(corpus.sum()) + m) / ((corpus + 1.0) * (float(target.sum()) + m))
    return np.floor(1000.0 * np.log(rate)).astype(np.int64)


def score(found: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) from ``features``."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batches):
        for batch in batches:
            many = batch.column("n_features").to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain[_numbers(batch.column("buckets"), kind)])])
            end = np.cumsum(many)
            weight = (sums[end] - sums[end - many]) // np.maximum(many, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n_words", "n_features")), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    weighed = found.mapInArrow(run, "id bigint, n_words bigint, n_features bigint, weight bigint")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u))))


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds rank: 1, 2, 3, ... for the drawn rows, NULL for the others. ``scored`` is read three times."""
    spark = scored.sparkSession
    able = F.col("n_words") >= least_words
    bars = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).toArrow()
    value, n = bars.column("score").to_numpy(), bars.column("n").to_numpy()
    order = np.argsort(-value)
    value, n = value[order], n[order]
    wanted, ahead = int(n.sum()) * percent // 100, np.cumsum(n) - n
    surviving = int((ahead < wanted).sum())
    if not surviving:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    offsets = spark.createDataFrame(pa.table({"score": value[:surviving], "ahead": ahead[:surviving]}))
    high = able & (F.col("score") >= int(value[surviving - 1]))
    within = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last())
    # a row for each score that survives, which are bounded as the histogram is
    ranked = scored.where(high).join(F.broadcast(offsets), "score").withColumn("rank", F.col("ahead") + F.row_number().over(within))
    ranked = ranked.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return ranked.union(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of docs: the drawn percent of rows that are long enough have a rank."""
    found = materialize(features(docs, id_col, text_col, grams, buckets), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), "id", "text", grams, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    scored = materialize(score(found, gain, seed), "scored")
    release(found)
    return draw(scored, least_words, percent).withColumnRenamed("id", id_col)


def query(spark, sf_dir):
    drawn = resample(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 is spelled out, as DuckDB has none: eight shifts for each byte of every distinct word.
SQL = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), dw AS MATERIALIZED (SELECT u, doc_id, len(words) AS n, words FROM d),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
docword AS MATERIALIZED (SELECT u, w, count(*) AS n FROM (SELECT u, unnest(words) AS w FROM dw) GROUP BY u, w),
benchword AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY w),
crc0 AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc0 WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc0 WHERE k = 8),
vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM docword UNION SELECT w FROM benchword)),
bucket AS MATERIALIZED (
    SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)),
        lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM vocabulary, crc
),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM docword JOIN bucket USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM benchword JOIN bucket USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((coalesce(s, 0) + 1) * (tt + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), totals),
weight AS (SELECT u, sum(n * gain) AS total FROM docword JOIN bucket USING (w) JOIN gain USING (bucket) GROUP BY u),
scored AS (
    SELECT doc_id, n AS n_features, CASE WHEN n = 0 THEN 0 ELSE floor(total::DOUBLE / n)::BIGINT END AS weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM dw LEFT JOIN weight USING (u)
), final AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM final)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * many // 100 THEN k END AS rank FROM ranked
"""
