"""Document fingerprints: a Merkle tree over blocks, paragraphs and sections of a text.

Paragraphs are the lines of a text; runs of blank lines part sections. A paragraph's leaves are blocks of words that end where the
hash of two neighbouring words says so, six words on average, so an edit changes the blocks it touches and leaves those before
and behind it as they were. Words are cut after 24 characters, for texts without blanks. A node's hash covers its children's
whole hashes: paragraphs are hashed by SHA-256, sections over their paragraphs' digests, the root over the sections' digests and
the breaks between them. The fingerprint writes the tree out:

    root|section=paragraph:leaf.leaf,paragraph:leaf|section=...

with all 64 hex digits for the root, the first 16 for sections and paragraphs and 8 for leaves. Equal texts have equal
fingerprints; the branches in which two fingerprints differ locate an edit. The likeness of two fingerprints is the Dice
coefficient of their distinct leaves, 1 for equal roots.

Edge cases: a NULL text counts as empty; an empty text has a root, one empty section and no leaves, and is like nothing but
itself; paragraphs of white space only have no leaves. A document with a NULL doc_id has no next one; a sole document follows
itself; rows that share a doc_id have the same next one, and are the next one by the row with the smallest beginning. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import let, materialize, release, table

#: One pair of neighbouring words in so many ends a block; characters of a word.
BLOCK_WORDS, WORD = 6, 24
BREAKS = r"\n(?:[\x20\t\r]*\n)+"


def _leaves(paragraph: Column) -> Column:
    """Block hashes of a paragraph, as integers. A block takes the last word before it along, so it has two words or more where
    its paragraph does."""

    def blocks(w: Column) -> Column:
        n = F.size(w)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.pmod(F.xxhash64(F.get(w, i - 1), F.get(w, i)), F.lit(BLOCK_WORDS)) == 0))

        def cut(e: Column) -> Column:
            first = lambda k: F.greatest(F.coalesce(F.get(e, k - 1), F.lit(1)), F.lit(1))
            return F.transform(e, lambda end, k: F.hash(F.slice(w, first(k), end - first(k) + 1)))

        return F.when(n == 0, F.array().cast("array<int>")).otherwise(let(ends, cut))

    return let(F.regexp_extract_all(paragraph, F.lit(f"[^\\x20\\x09-\\x0D]{{1,{WORD}}}"), F.lit(0)), blocks)


def _digits(leaf: Column) -> Column:
    return F.lpad(F.lower(F.hex(leaf.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")


def _digest(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, "").cast("binary"), 256)


def tree(text: Column) -> Column:
    """The Merkle tree below the root: array of sections (hash, paragraphs (hash, leaves)); hashes in 64 hex digits."""
    sections = F.split(F.coalesce(text, F.lit("")), BREAKS)

    def paragraph(line: Column) -> Column:
        return F.struct(F.sha2(line.cast("binary"), 256).alias("hash"), _leaves(line).alias("leaves"))

    def section(ps: Column) -> Column:
        return F.struct(_digest(F.transform(ps, lambda p: p["hash"])).alias("hash"), ps.alias("paragraphs"))

    return F.transform(sections, lambda s: let(F.transform(F.split(s, "\n"), paragraph), section))


def _root(sections: Column, text: Column) -> Column:
    """The root's hash. It also covers the exact breaks between sections, which the tree leaves out."""
    breaks = F.array_join(F.regexp_extract_all(text, F.lit(BREAKS), F.lit(0)), "|")
    return F.sha2(F.concat_ws("/", F.array_join(F.transform(sections, lambda s: s["hash"]), ""), breaks).cast("binary"), 256)


def _written(sections: Column) -> Column:
    short = lambda node: F.substring(node["hash"], 1, 16)
    paragraph = lambda p: F.concat_ws(":", short(p), F.when(F.size(p["leaves"]) > 0, F.array_join(F.transform(p["leaves"], _digits), ".")))
    return F.array_join(F.transform(sections, lambda s: F.concat(short(s), F.lit("="), F.array_join(F.transform(s["paragraphs"], paragraph), ","))), "|")


def _own_leaves(sections: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda p: p["leaves"])))))


def printed(text: Column) -> Column:
    """struct(print, leaves): the fingerprint of a text and its distinct leaf hashes."""
    text = F.coalesce(text, F.lit(""))
    return let(tree(text), lambda t: F.struct(F.concat_ws("|", _root(t, text), _written(t)).alias("print"), _own_leaves(t).alias("leaves")))


def rooted(text: Column) -> Column:
    """struct(root, leaves): what ``likeness`` needs of a text's fingerprint."""
    text = F.coalesce(text, F.lit(""))
    return let(tree(text), lambda t: F.struct(_root(t, text).alias("root"), _own_leaves(t).alias("leaves")))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text."""
    return printed(text)["print"]


def leaves(print_: Column) -> Column:
    """The distinct leaf hashes that a fingerprint has written out."""
    found = F.regexp_extract_all(print_, F.lit("[:.]([0-9a-f]{8})(?![0-9a-f])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.pmod(F.conv(x, 16, 10).cast("long") + (1 << 31), F.lit(1 << 32)) - (1 << 31)).cast("array<int>"))


def likeness(a: Column, b: Column, leaves_a: Column | None = None, leaves_b: Column | None = None) -> Column:
    """0 to 1: the Dice coefficient of two fingerprints' leaves, 1 for equal roots; roots alone serve where leaves are given."""
    la, lb = leaves(a) if leaves_a is None else leaves_a, leaves(b) if leaves_b is None else leaves_b
    both, total = F.size(F.array_intersect(la, lb)), F.size(la) + F.size(lb)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).when(total == 0, 0.0).otherwise(2.0 * both / total)


def changed_sections(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the sections of ``a`` that ``b`` has nowhere."""
    sa, sb = (F.transform(F.slice(F.split(x, "[|]"), 2, 1 << 30), lambda s: F.substring(s, 1, 16)) for x in (a, b))
    return F.filter(F.transform(sa, lambda s, i: F.when(~F.array_contains(sb, s), i)), lambda x: x.isNotNull())


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Paragraph hashes of ``a`` that ``b`` does not have: the branches in which an edit lies."""
    each = lambda x: F.regexp_extract_all(x, F.lit("(?<=[=,])([0-9a-f]{16})(?=[:,|]|$)"), F.lit(1))
    return F.array_except(each(a), each(b))


#: Ids are put in order by runs of 2^RUN_BITS; so many at most share a window.
RUN_BITS = 12
#: Bits of a key that each level of ``lower_keys`` leaves to one group.
SHIFTS = (16, 32, 64)


def lower_keys(keys: DataFrame) -> DataFrame:
    """(key, lower): the next smaller key of each distinct one, and the largest after the smallest.

    A tree of fixed fan-out over the bits of the key stands in for a global sort: a window never holds more keys than a
    group's range has, whatever their distribution.
    """
    level = keys.select("key", F.col("key").alias("top"))
    levels = []
    for k, shift in enumerate(SHIFTS):
        group = F.lit(0).cast("long") if shift == 64 else F.shiftright("key", shift - (SHIFTS[k - 1] if k else 0))
        level = level.withColumn("group", group)
        levels.append(level)
        level = level.groupBy("group").agg(F.max("top").alias("top")).select(F.col("group").alias("key"), "top")
    first = level.select(F.col("top").alias("first"))
    above = None
    for level in reversed(levels):
        rows = level.selectExpr("key", "top", "group", "lag(top) over (partition by group order by key) as prev")
        if above is not None:
            rows = rows.join(above.select(F.col("key").alias("group"), F.col("prev").alias("up")), "group", "left").withColumn("prev", F.coalesce("prev", "up"))
        above = rows.select("key", "prev")
    return above.crossJoin(F.broadcast(first)).select("key", F.coalesce("prev", "first").alias("lower"))


def next_ids(ids: DataFrame) -> DataFrame:
    """ids(doc_id, ...) of distinct doc_ids with next_id: the next smaller one, and the largest behind the smallest."""
    rows = ids.withColumn("run", F.shiftright("doc_id", RUN_BITS))
    tops = materialize(rows.groupBy(F.col("run").alias("key")).agg(F.max("doc_id").alias("top")), "run_tops")
    order = lower_keys(tops).join(tops.select(F.col("key").alias("lower"), "top"), "lower").select(F.col("key").alias("run"), "top")
    rows = rows.withColumn("below", F.lag("doc_id").over(Window.partitionBy("run").orderBy("doc_id")))
    out = materialize(rows.join(order, "run").withColumn("next_id", F.coalesce("below", "top")).drop("run", "below", "top"), "next_ids")
    release(tops)
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, next_own): each document with the beginning of the next one in descending order of doc_id, half
    as long as its own text, and that one's ``rooted`` fingerprint.

    The order is found on ids alone. Texts are shuffled once by doc_id; what a document gives to the one before it goes to that
    one's doc_id, so a task holds single texts at a time, however long its neighbours are.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = texts.where(F.col("doc_id").isNotNull())
    half = F.floor(F.length("text") / 2).cast("int")
    ids = materialize(known.groupBy("doc_id").agg(F.max(half).alias("half"), F.count("*").alias("rows")), "ids")
    order = next_ids(ids)
    given = known.join(order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to_id"), "half"), "doc_id")
    given = given.select("to_id", F.substring("text", F.lit(1), F.col("half")).alias("next_text"), rooted(F.col("text")).alias("next_own"))
    if order.where("rows > 1").take(1):
        given = given.groupBy("to_id").agg(F.min(F.struct("next_text", "next_own")).alias("x")).select("to_id", "x.*")
    release(ids)
    rows = known.join(given.withColumnRenamed("to_id", "doc_id"), "doc_id", "left")
    return rows.select("doc_id", "text", "next_text", "next_own").unionByName(texts.where(F.col("doc_id").isNull()), allowMissingColumns=True)


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the next."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(F.coalesce(next_text, F.lit("")), F.lit(1), half))


def query(spark, sf_dir):
    rows = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumns({"own": printed(F.col("text")), "new": printed(F.col("edited"))})
    a, b, c = F.col("own")["print"], F.col("new")["print"], F.col("next_own")["root"]
    la, lb, lc = F.col("own")["leaves"], F.col("new")["leaves"], F.col("next_own")["leaves"]
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        a.alias("fingerprint"),
        b.alias("edited_fingerprint"),
        likeness(a, b, la, lb).alias("near_edited"),
        F.when(F.col("next_own").isNull(), 0.0).otherwise(likeness(a, c, la, lc)).alias("near_next"),
    )
