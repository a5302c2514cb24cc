"""Edit-aware token counts: a stored segment tree of pre-tokens per document, in which an edit recounts only what it touches.

Leaves of the tree are short runs of pre-tokens; every node holds the characters and tokens below it. ``build_trees`` encodes
texts once into a table of trees; ``apply_edits`` takes such a table, however old, and a batch of edits to the next state of the
table. Documents without edits pass through as they are: a bitmap of the edited ids, of fixed size, tells them from the others, and
they are neither shuffled nor seen by Python. An edit restarts the pre-token pattern at the start of the leaf
that holds the last character that it cannot influence (a match depends on one character behind its end at most, so two
characters of context are enough) and stops at the first start of an old leaf behind the edit that is a boundary again: from there on
the old leaves hold. Only the pre-tokens between are encoded, and the sums on their leaves' paths to the root are updated.

Edits of a document apply in order, each to the text as the ones before left it; positions are in code points and are
clipped to the text. Edge cases: NULL and empty texts have 0 tokens and can be edited; NULL edits, and NULL fields of one,
count as none, 0 or the empty text; edits of documents that the table lacks, or of a NULL id, do nothing; repeated rows are
counted and edited one by one; extra columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, spread, table, unused
from tickloom.llm.exact_dedup import SCREEN_BITS, slot, through

LEAF = 32
#: Pre-tokens whose counts a Python worker remembers at most.
CACHED = 500_000
#: The columns of a tree: texts and numbers of pre-tokens of its leaves, characters and tokens of its nodes (root at 1, the
#: children of k at 2 k and 2 k + 1), and the root's tokens.
TREE = {"leaf_texts": "array<string>", "leaf_pretokens": "array<int>", "node_chars": "array<int>", "node_tokens": "array<int>", "n_tokens": "bigint"}


class CountTree:
    """The leaves of one text with their token counts; ``recounted`` is the number of pre-tokens encoded for edits."""

    def __init__(self, split: Callable[[str], list[str]], count: Callable[[str], int]):
        self.split, self.count, self.recounted = split, count, 0

    @classmethod
    def of(cls, text: str, split: Callable[[str], list[str]], count: Callable[[str], int]) -> CountTree:
        tree = cls(split, count)
        tree._set(tree._leaves(split(text), 0))
        return tree

    @classmethod
    def stored(cls, columns: tuple[list, list, list, list], split: Callable[[str], list[str]], count: Callable[[str], int]) -> CountTree:
        """The tree that the columns of a table hold; nothing is encoded."""
        tree = cls(split, count)
        tree.texts, tree.pretokens, tree.chars, tree.sums = map(list, columns)
        tree.base = len(tree.chars) // 2
        return tree

    def _leaves(self, pieces: list[str], least: int) -> list[tuple[str, int, int]]:
        """(text, pre-tokens, tokens) of the pieces in leaves of even size, ``least`` or more of them."""
        n = max(-(-len(pieces) // LEAF), least, 1)
        share = -(-len(pieces) // n)
        parts = [pieces[k * share : (k + 1) * share] for k in range(n)]
        return [("".join(p), len(p), sum(map(self.count, p))) for p in parts]

    def _set(self, leaves: list[tuple[str, int, int]]) -> None:
        """All nodes from the leaves' sums."""
        self.texts, self.pretokens = [x[0] for x in leaves], [x[1] for x in leaves]
        self.base = 1 << (len(leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.base), [0] * (2 * self.base)
        for k, (text, _, tokens) in enumerate(leaves):
            self.chars[self.base + k], self.sums[self.base + k] = len(text), tokens
        for k in range(self.base - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def _locate(self, at: int) -> tuple[int, int]:
        """(leaf, start) of the leaf that holds character ``at``; the last that holds any at the end."""
        k, start = 1, 0
        at = min(at, max(self.chars[1] - 1, 0))
        while k < self.base:
            k *= 2
            if at >= start + self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.base, start

    def replace(self, start: int, length: int, new: str) -> None:
        """Replace ``length`` characters from ``start`` by ``new``."""
        size, n = self.chars[1], len(self.texts)
        start = min(max(start, 0), size)
        end = min(start + max(length, 0), size)
        leaf, begin = self._locate(max(start - 2, 0))
        shift, tail, read, more = len(new) - (end - start), leaf, begin, end + 64
        old, starts = [], {}  # of the leaves from the restart on, as far as read: texts, and leaves by their new starts
        while True:
            while tail < n and (read < more or not old):
                starts.setdefault(read + shift, tail)
                old.append(self.texts[tail])
                read += len(old[-1])
                tail += 1
            at_end = tail >= n
            whole = "".join(old)
            fresh = whole[: start - begin] + new + whole[end - begin :]
            done, place, limit, meet = [], begin, begin + len(fresh), None
            for piece in self.split(fresh):
                if place >= start + len(new) and place + 2 <= limit and starts.get(place, leaf) > leaf:
                    meet = starts[place]
                    break
                done.append(piece)
                place += len(piece)
            if meet is None and at_end:
                meet = n
            if meet is not None:
                break
            more = read + 2 * (read - begin) + 64
        self.recounted += len(done)
        self._splice(leaf, meet, done)

    def _splice(self, leaf: int, tail: int, done: list[str]) -> None:
        """Put the pre-tokens ``done`` in place of the leaves from ``leaf`` up to ``tail``."""
        have = tail - leaf
        if len(done) > 4 * LEAF * have:
            first = self.base
            known = [(t, p, s) for t, p, s in zip(self.texts, self.pretokens, self.sums[first:], strict=False)]
            self._set(known[:leaf] + self._leaves(done, 0) + known[tail:])
            return
        share = -(-len(done) // have) if done else 0
        paths = set()
        for k in range(leaf, tail):
            own = done[(k - leaf) * share : (k - leaf + 1) * share]
            node = self.base + k
            self.texts[k], self.pretokens[k] = "".join(own), len(own)
            self.chars[node], self.sums[node] = len(self.texts[k]), sum(map(self.count, own))
            paths.add(node // 2)
        while paths:
            for node in paths - {0}:
                self._add(node)
            paths = {node // 2 for node in paths if node > 1}

    def columns(self) -> tuple:
        return self.texts, self.pretokens, self.chars, self.sums, self.tokens


_counters: dict[str, tuple] = {}


def counter(path: str, pattern: str) -> tuple[Callable[[str], list[str]], Callable[[str], int]]:
    """(split, count) of a tiktoken vocabulary, once per Python worker; counts are remembered up to a bound."""
    if path not in _counters:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        memory: dict[str, int] = {}

        def count(piece: str) -> int:
            n = memory.get(piece)
            if n is None:
                if len(memory) >= CACHED:
                    memory.clear()
                n = memory[piece] = len(encoding.encode_ordinary(piece))
            return n

        _counters[path] = regex.compile(pattern).findall, count
    return _counters[path]


def _schema(fields) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} {t}" for n, t in TREE.items())])


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    types = (pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3, pa.int64())
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]


def build_trees(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Each row's text as a tree: the columns of TREE in place of the text, which is ``text_of`` of them."""
    kept = [f for f in docs.schema if f.name != text_col and f.name not in TREE]

    def run(batches):
        split, count = counter(vocabulary, pattern)
        for batch in batches:
            rows = [CountTree.of(t.as_py() or "", split, count).columns() for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *_arrays(rows)], [*(f.name for f in kept), *TREE])

    return docs.select(*(f.name for f in kept), text_col).mapInArrow(run, _schema(kept))


def text_of(leaf_texts: Column | str = "leaf_texts") -> Column:
    return F.array_join(leaf_texts, "")


def edit_trees(trees: DataFrame, vocabulary: str, pattern: str, edits_col: str = "edits") -> DataFrame:
    """The trees after each row's edits, an array of structs (start, length, replacement), and n_recounted.

    n_recounted is the number of pre-tokens encoded for the edits. The edits are dropped.
    """
    kept = [f for f in trees.schema if f.name not in (edits_col, "n_recounted", *TREE)]
    names = [*(f.name for f in kept), *TREE, "n_recounted"]

    def run(batches):
        for batch in batches:
            edits = batch.column(edits_col)
            edited = pa.array([bool(n) for n in edits.value_lengths().to_pylist()], pa.bool_())
            same = batch.filter(pa.array([not x for x in edited.to_pylist()], pa.bool_()))
            if same.num_rows:
                yield pa.RecordBatch.from_arrays([*(same.column(n) for n in names[:-1]), pa.array([0] * same.num_rows, pa.int64())], names)
            todo = batch.filter(edited)
            if not todo.num_rows:
                continue
            split, count = counter(vocabulary, pattern)
            rows, recounted = [], []
            for *tree, changes in zip(*(todo.column(n) for n in list(TREE)[:4]), todo.column(edits_col), strict=True):
                tree = CountTree.stored(tuple(x.as_py() for x in tree), split, count)
                for edit in changes.as_py():
                    if edit:
                        tree.replace(edit["start"] or 0, edit["length"] or 0, edit["replacement"] or "")
                rows.append(tree.columns())
                recounted.append(tree.recounted)
            yield pa.RecordBatch.from_arrays([*(todo.column(f.name) for f in kept), *_arrays(rows), pa.array(recounted, pa.int64())], names)

    return trees.select(*names[:-1], edits_col).mapInArrow(run, f"{_schema(kept)}, n_recounted bigint")


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The next state of a table of trees by doc_id after edits(doc_id, seq, start, length, replacement), with n_recounted.

    Both tables are read twice. A bit that two ids share sends a document to the edits' join, where it meets none; with many more
    edited ids than bits, all go there.
    """
    name, asked = unused(trees, "edits", "asked")
    edits = edits.withColumn("doc_id", F.col("doc_id").cast(trees.schema["doc_id"].dataType)).where("doc_id is not null")
    place = slot(["doc_id"], SCREEN_BITS)
    ids = edits.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    marked = through(trees, ids, ["doc_id"], SCREEN_BITS, asked)
    untouched = marked.where(~F.col(asked)).drop(asked).withColumn("n_recounted", F.lit(0).cast("bigint"))
    fields = ("start", "length", "replacement")
    each = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", *fields))).alias(name))
    each = each.withColumn(name, F.transform(name, lambda e: F.struct(*(e[f].alias(f) for f in fields))))
    edited = edit_trees(marked.where(asked).drop(asked).join(each, "doc_id", "left"), vocabulary, pattern, name)
    return edited.union(untouched.select(*edited.columns))


def query_edits(text):
    """The edits that the query makes in every document: a replacement a third into it, an insertion of its own beginning in
    the middle, and a deletion at the start."""
    n = F.length(F.coalesce(text, F.lit("")))
    one = lambda start, length, new: F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), new.alias("replacement"))
    return F.array(one(F.floor(n / 3), 12, F.lit("an edit, 2 words")), one(F.floor(n / 2), 0, F.substring(text, 1, 40)), one(F.lit(0), 5, F.lit("")))


def query(spark, sf_dir):
    """Counts of all documents before and after the edits, which start from the stored table of trees."""
    import public_tokenizers

    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    trees = materialize(build_trees(docs, vocabulary, pattern), "count_trees", compression="zstd")
    pretokens = F.aggregate("leaf_pretokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = trees.withColumns({"n_before": F.col("n_tokens"), "n_pretokens": pretokens, "edits": query_edits(text_of())})
    out = edit_trees(rows, vocabulary, pattern)
    return out.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_pretokens", "n_recounted")
