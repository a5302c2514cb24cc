"""Packing: optimal length buckets over the global histogram, and token-budget batches inside each.

Sequences longer than ``max_length`` are cut into parts of that length and a rest, so none is lost. The histogram of part
lengths has ``max_length`` bars at most, whatever the corpus; dynamic programming over it picks the bucket bounds with the
least padding. A part belongs to the smallest bound that holds it, and a batch of a bucket takes as many parts as its
bound fits into ``budget`` tokens.

Ranks inside a bucket come from salted groups of bounded size and the sums of the groups before, so no bucket is sorted in one
task; every batch of a bucket is full but its last.

Edge cases: rows without tokens (NULL or 0) are kept, without a bucket or batch; repeated rows are packed one by one; an empty
table gives an empty result; extra columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_batches, materialize, spread, table, unused
from tickloom.llm.sentencepiece_bpe import count_column

MAX_LENGTH, BUCKETS, BUDGET = 2048, 16, 65_536
OUT = ("part", "part_tokens", "bucket", "batch", "slot")
#: Rows of a bucket that one salted group has on average at most.
GROUP_ROWS = 20_000
#: Texts that go to Python together for their token counts.
ARROW_BATCH = "4m"


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The at most ``buckets`` bounds, ascending, that minimise the sum of (bound - length) * count.

    Exact dynamic programming over the distinct lengths; ties go to the earlier cut.
    """
    order = np.argsort(lengths)
    x, c = np.array(lengths, np.int64)[order], np.array(counts, np.int64)[order]
    n = len(x)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(c)])
    mass = np.concatenate([[0], np.cumsum(c * x)])
    # cost[i, j]: padding of lengths i..j-1 under the bound x[j - 1]
    cost = x[None, :] * (rows[None, 1:] - rows[:-1, None]) - (mass[None, 1:] - mass[:-1, None])
    far = np.iinfo(np.int64).max // 4
    cost = np.where(np.arange(n)[:, None] <= np.arange(n)[None, :], cost, far)
    best, cuts = cost[0], []
    for _ in range(min(buckets, n) - 1):
        total = np.concatenate([[0], best[:-1]])[:, None] + cost
        cut = np.argmin(total, axis=0)
        cuts.append(cut)
        best = total[cut, np.arange(n)]
    bounds, j = [int(x[-1])], n - 1
    for cut in reversed(cuts):
        i = int(cut[j])
        if i == 0:
            break
        j = i - 1
        bounds.append(int(x[j]))
    return bounds[::-1]


def pack(df: DataFrame, length_col: str = "n_tokens", key_cols: tuple[str, ...] = ("doc_id",), max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per part: adds part, part_tokens, bucket (its bound), batch (number inside the bucket) and slot.

    ``key_cols`` order the parts inside a bucket, after a hash of them. The input is read twice; materialise it where it
    is costly.
    """
    clear = df.drop(*OUT)
    salted, roomy, ranks, begin, rows_of = unused(clear, "_salt", "_room", "_rank", "_start", "_n")
    n = F.coalesce(F.col(length_col).cast("long"), F.lit(0))
    last = F.greatest(F.floor((n - 1) / max_length), F.lit(0))
    parts = clear.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    parts = parts.withColumn("part_tokens", F.least(n - F.col("part") * max_length, F.lit(max_length).cast("long")))
    bars = parts.where(F.col("part_tokens") > 0).groupBy("part_tokens").count().collect()
    bounds = optimal_bounds([r["part_tokens"] for r in bars], [r["count"] for r in bars], buckets)
    bucket = salts = room = F.lit(None).cast("int")
    for k in reversed(range(len(bounds))):
        inside = F.col("part_tokens") <= bounds[k]
        rows = sum(r["count"] for r in bars if (bounds[k - 1] if k else 0) < r["part_tokens"] <= bounds[k])
        bucket, salts = F.when(inside, bounds[k]).otherwise(bucket), F.when(inside, -(-rows // GROUP_ROWS)).otherwise(salts)
        room = F.when(inside, max(1, budget // bounds[k])).otherwise(room)
    empty = F.col("part_tokens") <= 0
    hashed = F.xxhash64(*key_cols, "part")
    parts = parts.withColumns({"bucket": F.when(~empty, bucket), salted: F.when(~empty, F.pmod(hashed, salts)).otherwise(F.pmod(hashed, F.lit(1 << 20))), roomy: F.when(~empty, room)})
    group = Window.partitionBy("bucket", salted).orderBy(F.xxhash64(*key_cols, "part"), *key_cols, "part", "part_tokens")
    sizes = parts.where(~empty).groupBy("bucket", salted).agg(F.count("*").alias(rows_of))
    before = Window.partitionBy("bucket").orderBy(salted).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", salted, F.coalesce(F.sum(rows_of).over(before), F.lit(0)).alias(begin))
    ranked = parts.withColumn(ranks, F.row_number().over(group)).join(starts, ["bucket", salted], "left")
    rank = F.col(begin) + F.col(ranks) - 1
    out = ranked.withColumns({"batch": F.floor(rank / F.col(roomy)), "slot": F.pmod(rank, F.col(roomy)).cast("int")})
    return out.select(*clear.columns, *OUT)


def counted(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens), written once as ``pack`` reads it twice."""
    with arrow_batches(docs.sparkSession, ARROW_BATCH):
        return materialize(count_column(docs.select("doc_id", "text"), model_path), "token_counts")


def query(spark, sf_dir):
    import public_tokenizers

    return pack(counted(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model")))
