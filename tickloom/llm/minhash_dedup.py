"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's signature is 65 b-bit MinHash symbols (b = 16) of its word shingles. Two signatures within distance 25 (symbols
that differ) agree, by the pigeonhole principle, in one of 13 chunks of five symbols but for one symbol at most. The allowed
chunk errors are enumerated: each chunk gives five keys, each without one of its symbols, and a pair within the distance has a
key in common, without exception. At a Jaccard similarity of 0.8 the distance has mean 13 and deviation 3.2, so a pair is beyond
25 with a probability of 2 in 10,000 at the limit, and much less above it; and to part a group, all of its links must be.

Links, not pairs:

1. Documents with equal shingle sets become one class by a digest of the set; its smallest doc_id stands for it.
2. Every bucket of a key is put in a random order of its own, and neighbours meet: a bucket of n members gives n - 1 pairs.
   Each batch first chains its own repeats of a key, so a key sends one row per batch to the shuffle however common it is.
3. Each class is checked against the nearest few that it met, on full shingle sets; the links found give first components.
   A large group falls into one piece here, since its members met many random partners.
4. What is left are pairs of one bucket in different components. All of those within the signature distance, each once at
   its first common key, are checked on full sets too, but for those that a bit map of their shingles proves to be no links:
   a bit that only one of two maps has is a shingle that only one of the sets has. Nothing is left to chance there.
5. Buckets of more than HOT_BUCKET classes, as those of unlike texts that share boilerplate, are split by a further key
   instead of comparing all members with each other: two linked sets have a shingle in common among the rarest fifth of
   either one, in any common order, so their classes meet there. Common shingles come last in that order, so classes that
   share only these do not meet. Pairs that meet must be within the signature distance as everywhere, so whether two texts are
   linked does not depend on the size of a bucket. Final components come from all links.

Edge cases: words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than a shingle is one
shingle, a NULL, empty or blank text has none and is linked with nothing. Rows with a repeated doc_id share its component. A
NULL doc_id is linked with nothing and kept. Extra columns are ignored; ``deduplicate`` keeps all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import LOWER, UPPER, materialize, release, table, unused
from tickloom.llm.components import components
from tickloom.llm.kernels import FOLD, U64, Residues, Rolling, mix, ranges, slices, text_bytes, word_spans

SYMBOLS, CHUNK, DISTANCE = 65, 5, 25
CHUNKS = SYMBOLS // CHUNK
assert DISTANCE < 2 * CHUNKS, "a pair within the distance must have a chunk with one error at most"
#: The nearest classes that a class is checked against before components are formed.
NEAREST = 8
#: Bits of the map of a class's shingles.
MAP_BITS = 2048
#: Classes from which a bucket is split by a further key.
HOT_BUCKET = 256
#: The least similarity, in percent, that DISTANCE is made for.
LEAST_PERCENT = 80
BYTES_AT_ONCE = 2_000_000
FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
OFFSETS = mix(np.arange(101, SYMBOLS + 101, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct shingle hashes of each row, ascending, one row after another."""
    data, offsets = text_bytes(column)
    data = FOLD[data]
    start, end, first = word_spans(data, offsets)
    own = mix(Rolling(data).hash(start, end) + mix(Residues(data).hash(start, end)))
    n = np.diff(first)
    size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = ranges(first[:-1], size)
    short = np.repeat(np.minimum(n, words), size)
    value = np.full(len(at), 0x2545F4914F6CDD1D, U64)
    for k in range(words):
        inside = short > k
        value = np.where(inside, mix(value + own[np.minimum(at + k, max(len(own) - 1, 0))]) if len(own) else value, value)
    row_start = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(row_start[:-1].tolist(), row_start[1:].tolist(), strict=True):
        if b - a > 1:
            value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = value[1:] != value[:-1]
    fresh[row_start[:-1][size > 0]] = True
    row = np.repeat(np.arange(len(size)), size)
    return value[fresh], np.bincount(row[fresh], minlength=len(size))


def _sums(hashes: np.ndarray, start: np.ndarray, some: np.ndarray, fold) -> np.ndarray:
    out = np.zeros(len(some), U64)
    if some.any():
        out[some] = fold.reduceat(hashes, start[some])
    return out


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of SYMBOLS 16-bit symbols for each set; zeros for empty ones."""
    start, some = np.cumsum(counts) - counts, counts > 0
    out = np.zeros((len(counts), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        low = _sums(hashes * FACTORS[k] + OFFSETS[k], start, some, np.minimum)
        out[:, k] = (mix(low) >> U64(48)).astype(np.uint16)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _read(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def sign(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): the size, a 128-bit digest and the signature of each document's shingle set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BYTES_AT_ONCE):
                hashes, counts = shingle_sets(part.column("text"), words)
                start, some = np.cumsum(counts) - counts, counts > 0
                d1, d2 = (_sums(mix(hashes ^ U64(c)), start, some, np.add).view(np.int64) for c in (0x1B873593, 0xCC9E2D51))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(d1), pa.array(d2), _binary(signatures(hashes, counts))], ["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary")


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * CHUNK) keys: of each chunk, with each of its symbols left out in turn."""
    chunks = sig.reshape(len(sig), CHUNKS, CHUNK).astype(U64)
    out = np.empty((len(sig), CHUNKS, CHUNK), U64)
    for j in range(CHUNK):
        rest = [k for k in range(CHUNK) if k != j]
        value = sum(chunks[:, :, k] << U64(16 * i) for i, k in enumerate(rest))
        out[:, :, j] = mix(mix(value) + (np.arange(CHUNKS, dtype=U64) * U64(CHUNK) + U64(j + 1))[None, :] * U64(0x9E3779B97F4A7C15))
    return out.reshape(len(sig), CHUNKS * CHUNK).view(np.int64)


def bucket_neighbours(classes: DataFrame) -> DataFrame:
    """(a, b): neighbours in the buckets of all keys, each bucket in a random order of its own; a > b, repeats left out.

    A bucket of n members gives n - 1 pairs, and a member of many buckets meets many random partners.
    """

    def run(batches):
        for batch in batches:
            ids = np.array(batch.column("id"))
            key, row = chunk_keys(_read(batch.column("sig"))).ravel(), np.repeat(ids, CHUNKS * CHUNK)
            order = np.lexsort((mix(row.view(U64) + mix(key.view(U64))), key))
            key, row = key[order], row[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            before = np.concatenate([row[:1], row[:-1]])
            # a repeat within the batch is settled here and goes on under a key of its own
            key = np.where(head, key, mix(row.view(U64) ^ key.view(U64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.array(before, mask=head)], ["key", "a", "settled"])

    rows = classes.select("id", "sig").mapInArrow(run, "key bigint, a bigint, settled bigint")
    line = Window.partitionBy("key", F.col("settled").isNull()).orderBy(F.xxhash64("key", "a"))
    rows = rows.withColumn("b", F.coalesce("settled", F.lag("a").over(line))).where(F.col("a") != F.col("b"))
    return rows.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def nearest_pairs(near: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b, distance) that are among the nearest few of either end."""
    ends = near.select("a", "b", "distance", F.explode(F.array("a", "b")).alias("end"))
    line = Window.partitionBy("end").orderBy("distance", "a", "b")
    return ends.withColumn("k", F.row_number().over(line)).where(F.col("k") <= most).select("a", "b").distinct()


def within_distance(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, distance) of the pairs whose signatures are within DISTANCE."""
    sides = [classes.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                apart = (_read(batch.column("sig_a")) != _read(batch.column("sig_b"))).sum(1)
                near = pa.array(apart <= DISTANCE)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart)], ["a", "b", "distance"]).filter(near)

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint, distance bigint")


def bit_maps(sets: DataFrame) -> DataFrame:
    """(id, n, bits): the size of a set and the map of its shingles as array<bigint>: bit h modulo MAP_BITS for each hash h."""

    def run(batches):
        for batch in batches:
            lists = batch.column("shingles")
            counts = np.array(lists.value_lengths(), np.int64)
            hashes = np.array(lists.flatten(), np.int64).view(U64)
            cells = np.zeros((len(counts), MAP_BITS), bool)
            cells[np.repeat(np.arange(len(counts)), counts), (hashes % U64(MAP_BITS)).astype(np.int64)] = True
            longs = np.packbits(cells, axis=1, bitorder="little").view(np.int64)
            offsets = pa.array((np.arange(len(longs) + 1) * longs.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(longs.ravel()))], ["id", "n", "bits"])

    return sets.mapInArrow(run, "id bigint, n bigint, bits array<bigint>")


def _may_link(percent: int) -> str:
    """SQL condition on x and y (n, bits) that every link meets.

    A link has percent / (100 + percent) of both sizes in common at least; the shingles that only one has are at least as
    many as the bits that only its map has.
    """
    alone = "aggregate(zip_with({0}.bits, {1}.bits, (p, q) -> bit_count(p & ~q)), 0, (s, e) -> s + e)"
    enough = "{2} * ({0}.n - " + alone + ") >= {3} * (x.n + y.n)"
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {enough.format('x', 'y', 100 + percent, percent)} and {enough.format('y', 'x', 100 + percent, percent)}"


def cross_pairs(classes: DataFrame, sets: DataFrame, percent: int, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): the pairs of classes(id, component, sig) in one bucket, of different components, that may be links.

    Pairs of buckets of ``hot`` classes at most are those within DISTANCE, each once; larger buckets leave theirs to
    ``rare_pairs``.
    """

    def run(batches):
        for batch in batches:
            sig = _read(batch.column("sig"))
            again = pa.array(np.repeat(np.arange(batch.num_rows), CHUNKS * CHUNK))
            spot = pa.array(np.tile(np.arange(CHUNKS * CHUNK, dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(chunk_keys(sig).ravel()), spot, *(batch.column(n).take(again) for n in ("id", "component"))], ["key", "spot", "id", "component"])

    def split(batches):
        for batch in batches:
            sig = _read(batch.column("sig"))
            cells = pa.ListArray.from_arrays(pa.array((np.arange(len(sig) + 1) * SYMBOLS).astype(np.int32)), pa.array(sig.view(np.int16).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), cells], ["id", "cells"])

    rows = classes.select("id", "component", "sig").mapInArrow(run, "key bigint, spot int, id bigint, component bigint")
    # buckets of one component have nothing to offer
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    rows = materialize(rows.join(mixed.select("key", (F.col("members") > hot).alias("hot")), "key"), "mixed_buckets")
    ids = materialize(rows.groupBy("id", "component").agg(F.max("hot").alias("hot"), F.min("hot").alias("only_hot")), "mixed_ids")
    maps = materialize(bit_maps(sets.join(ids, "id", "left_semi")), "bit_maps")
    more = maps.join(classes.select("id", "sig").mapInArrow(split, "id bigint, cells array<smallint>"), "id")
    cool = materialize(rows.where(~F.col("hot")).drop("hot").join(more.join(ids.where("not only_hot").select("id"), "id"), "id"), "mapped_buckets")
    x, y = cool.alias("x"), cool.alias("y")
    errors = f"transform(sequence(0, {CHUNKS - 1}), c -> size(filter(slice(wrong, c * {CHUNK} + 1, {CHUNK}), e -> e)))"
    first_key = f"""x.spot div {CHUNK} = array_position(transform(errs, e -> e <= 1), true) - 1
      and if(errs[x.spot div {CHUNK}] = 0, x.spot % {CHUNK} = 0, wrong[x.spot])"""
    near = F.expr(f"""{_may_link(percent)}
      and transform(array(zip_with(x.cells, y.cells, (p, q) -> p != q)), wrong -> size(filter(wrong, e -> e)) <= {DISTANCE}
      and transform(array({errors}), errs -> {first_key})[0])[0]""")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & near)
    pairs = pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))
    split_up = within_distance(rare_pairs(ids.where("hot").select("id", "component"), sets, maps, percent), classes).select("a", "b")
    out = materialize(pairs.union(split_up), "cross_pairs")
    release(rows, ids, maps, cool)
    return out


def rare_pairs(classes: DataFrame, sets: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of classes(id, component) of different components that may be links and share a rare shingle.

    Of two sets with this similarity each has n - ceil(percent * n / 100) + 1 shingles, first in any order common to both,
    of which the two have one in common. The order is by the number of classes that have a shingle; those that
    a single class has take their places in it but need no row.
    """
    each = sets.join(classes, "id").select("id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("classes")).where("classes > 1")
    own = Window.partitionBy("id")
    rows = each.join(common, "shingle").withColumns({"place": F.row_number().over(own.orderBy("classes", "shingle")), "shared": F.count("*").over(own)})
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rows = rows.where(F.col("place") + F.col("n") - F.col("shared") <= first).select("shingle", "id", "component")
    rows = rows.join(maps, "id")
    x, y = rows.alias("x"), rows.alias("y")
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") < F.col("y.component")) & F.expr(_may_link(percent)))
    return pairs.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles): whole shingle sets, ascending, of the documents in ids(id)."""
    rows = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BYTES_AT_ONCE):
                hashes, counts = shingle_sets(part.column("text"), words)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], ["id", "shingles"])

    return rows.mapInArrow(run, "id bigint, shingles array<bigint>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    sides = [sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab"]
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, hot: int = HOT_BUCKET) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id and kept (doc_id is its component's smallest)."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"the signature distance finds links of {LEAST_PERCENT} percent and more, not of {percent}")
    docs = docs.select("doc_id", "text")
    signed = materialize(sign(docs, words), "signatures")
    usable = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(usable.groupBy("d1", "d2", "n_shingles", "sig").agg(F.min("doc_id").alias("id")), "classes")
    pairs = materialize(bucket_neighbours(classes), "neighbours")
    met = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "met")
    sets = materialize(full_sets(docs, met, words), "full_sets")
    links = materialize(confirm(nearest_pairs(within_distance(pairs, classes), NEAREST), sets, percent), "first_links")
    release(pairs)
    partial = components(links)
    left = classes.select("id", "sig").join(met, "id", "left_semi").join(partial, "id", "left").withColumn("component", F.coalesce("component", "id"))
    cross = cross_pairs(left, sets, percent, hot)
    found = components(links.union(confirm(cross, sets, percent)))
    release(met, sets, links, partial, cross)
    names = classes.join(found, "id", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    own = signed.select("doc_id", "n_shingles", "d1", "d2")
    out = own.join(names, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document of each group, with all of its columns.

    Of rows that share a doc_id, the one with the smallest text stays; those with a NULL doc_id all do.
    """
    gone, many, place = unused(docs, "gone", "many", "place")
    found = near_duplicates(docs, words, percent).where(F.col("doc_id").isNotNull())
    marked = found.groupBy("doc_id").agg((~F.bool_or("kept")).alias(gone), (F.count("*") > 1).alias(many)).where(F.col(gone) | F.col(many))
    marked = materialize(marked, "marked")
    kept = docs.join(marked, "doc_id", "left").where(~F.coalesce(gone, F.lit(False)))
    once, again = kept.where(F.col(many).isNull()), kept.where(F.col(many))
    if marked.where(F.col(many) & ~F.col(gone)).take(1):
        first = again.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(place) == 1)
        once = once.unionByName(first.drop(place))
    return once.select(docs.columns)


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


#: The query's rows from all pairs with a shingle in common; its result does not depend on signatures.
SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS at FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.at)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.at) AS component_id, d.doc_id = min(r.at) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n"""
