"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Texts are equal when they are identical after each run of ASCII white space is replaced by one blank.

1. A first look at each row gives the length of its text and a hash of its first 256 characters: 12 bytes a row are kept.
2. Rows whose length no other row has are done. Of the others, those with a length and a beginning of their own are done.
3. What is left sets bits in a screen of fixed size (8 MB whatever the corpus), which goes to every task: one of lengths
   before beginnings are grouped, one of lengths and beginnings before the second look at the texts, which hashes only those that
   it lets through. A bit that is set by chance costs a row or a hash that meets no other; no row of a group is missed. No
   length or beginning gathers its rows in one task, however common it is.
4. Groups have equal length and equal SHA-256. They are counted before the shuffle, and their one row each is joined back on
   the rows that are in question; rows with a text of their own are never shuffled. A group of any size is split by Spark's
   skew handling, as the join's other side has one row for it.

Of equal texts, the row with the smallest id stays. Edge cases: NULL is the empty text, so NULL and empty texts are one group;
a text of white space only is one blank. A NULL id comes after all others. Of rows that repeat id and text, exactly one stays.
Very long texts are only hashed. An empty table gives an empty result. Extra columns are carried where the caller asks for
them; those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACES, materialize, table, unused

#: Characters of the beginning that is hashed.
PREFIX = 256
#: Bits of the screen. A bitmap of Spark has 32,768, so it is 2,048 rows of 4 KB.
SCREEN_BITS = 1 << 26
OUT = ("keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one blank; empty for NULL."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def slot(keys: list[str], bits: int) -> Column:
    """The bit of a screen that the keys' values have."""
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def screen(keys: DataFrame, cols: list[str], bits: int) -> DataFrame:
    """(bucket, bits): a bitmap with a bit for each value of cols that more than one row has."""
    place = slot(cols, bits)
    shared = keys.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")
    return shared.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def through(df: DataFrame, bitmap: DataFrame, cols: list[str], bits: int, flag: str) -> DataFrame:
    """df with a flag that is true for all values of the screen, and for few others. The bitmap's size is fixed, so it is broadcast."""
    own, bucket, bitset = unused(df, "_own", "_bucket", "_bits")
    place = slot(cols, bits)
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bitset, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.col(bitset).isNotNull() & (F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
    joined = df.withColumn(own, F.bitmap_bucket_number(place)).join(F.broadcast(bitmap.toDF(bucket, bitset)), F.col(own) == F.col(bucket), "left")
    return joined.select(*df.columns, on.alias(flag))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Iterable[str] = (), prefix_chars: int = PREFIX, screen_bits: int = SCREEN_BITS) -> DataFrame:
    """Every row as (id, carried columns, keep_id, group_size, kept). The texts are read twice."""
    kept_cols = [c for c in dict.fromkeys([id_col, *carry]) if c.lower() not in OUT]
    length, prefix, full, row, asked_for, first, size = unused(df, "_length", "_prefix", "_full", "_row", "_open", "_first", "_size")
    normal = normalised(F.col(text_col))
    keyed = df.withColumns({length: F.octet_length(normal), prefix: F.xxhash64(F.substring(normal, 1, prefix_chars))})
    keys = materialize(keyed.select(length, prefix), "beginnings")
    alike = through(keys, screen(keys, [length], screen_bits), [length], screen_bits, asked_for).where(asked_for)
    seen = through(keyed, screen(alike, [length, prefix], screen_bits), [length, prefix], screen_bits, asked_for)
    marked = seen.select(*kept_cols, F.col(length), F.when(F.col(asked_for), F.unhex(F.sha2(normal, 256))).alias(full), F.monotonically_increasing_id().alias(row))
    marked = materialize(marked, "hashed")
    alone = marked.where(F.col(full).isNull()).select(*kept_cols, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    asked = marked.where(F.col(full).isNotNull())
    best = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row"))).alias(first)
    # written, so that both sides of the join are plain shuffles, which Spark can split where a group is large
    found = materialize(asked.groupBy(length, full).agg(best, F.count("*").alias(size)).where(F.col(size) > 1), "groups")
    joined = asked.join(found, [length, full], "left")
    grouped = F.col(size).isNotNull()
    together = joined.select(
        *kept_cols,
        F.when(grouped, F.col(f"{first}.id")).otherwise(F.col(id_col)).alias("keep_id"),
        F.coalesce(F.col(size), F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col(f"{first}.row") == F.col(row), F.lit(True)).alias("kept"),
    )
    return alone.union(together)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    plain = df.toDF(*names.values())
    kept = groups(plain, names[id_col], names[text_col], carry=plain.columns).where("kept")
    return kept.select([F.col(short).alias(c) for c, short in names.items()])


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs.withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256)), carry=["text_sha256"])


SQL = r"""
WITH t AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), w AS (
    SELECT doc_id, text_sha256, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER g AS k
    FROM t WINDOW g AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM w
"""
