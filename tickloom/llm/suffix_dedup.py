"""Suffix-array dedup: remove every byte that a string of ``length`` bytes covers which also starts earlier in the corpus.

Earlier means a smaller doc_id, or the same document and an earlier start; overlaps count; strings are judged on the input.
A full suffix array of the corpus would shuffle every byte's suffix with its bytes. Only suffixes that can repeat are sorted:

1. Every string of ``length`` bytes has an anchor, the leftmost of its ``gram``-byte grams with the smallest hash. Equal strings
   have equal anchors, so the starts of a document fall into runs that share an anchor, about one run in 35 bytes. Runs whose
   gram has no equal hash anywhere hold no repeat and go; hashes decide nothing else.
2. The runs that are left get their bytes from their texts. Sampled splitters range-partition them by their leading tokens, the
   first bytes of the gram; leading bytes that many grams share are a range of many buckets, by gram. A bucket sorts its runs
   by multikey quicksort over eight-byte words. Runs that equal an earlier
   neighbour, byte by byte, are repeats as a whole; of the others with one gram the suffixes of all starts are sorted and
   compared with their neighbours in the same way.
3. Equal strings have equal grams and so equal leading tokens: no splitter can stand between them, and nothing is left to compare
   across the boundaries of buckets.

Hot groups: batches sort their own runs first and send one of equal ones, so copies of a passage send one row a batch, however
many they are. A gram with more than ``hot_runs`` runs would still make a bucket too large, where the bytes around it differ:
the starts of its runs go on their own, each to a bucket that a hash of its whole string draws, and are sorted there as the
others are.

Texts are shuffled once, by doc_id, for step 2 and the cutting; nothing of the corpus passes through the driver but a
bounded sample of leading tokens for the splitters, which steer balance and not results.

Edge cases: NULL and empty texts have no bytes; texts shorter than ``length`` lose nothing; rows that share a doc_id come in
order of their texts; a row with a NULL doc_id takes no part and keeps its text. Extra columns are ignored by ``repeats``;
``cut`` keeps all columns and cuts at characters: a character of which any byte is removed goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, spread, table, unused
from tickloom.llm.kernels import U64, Rolling, mix, ranges, slices, text_bytes

LENGTH, GRAM = 100, 32
#: Bytes of text that are searched for anchors together, that its arrays cover at a time, and whose runs are sorted together.
BYTES_AT_ONCE, PIECE, SORTED_AT_ONCE = 3_000_000, 500_000, 32_000_000
#: Runs that a task packs together, starts of hot grams that it sends together, and starts that it sorts together.
RUNS_AT_ONCE, STARTS_AT_ONCE, SORTED_STARTS = 500_000, 100_000, 400_000
#: One gram in so many is sampled for splitters, leading bytes that these look at, and the most samples that the driver gets.
ONE_IN, LEAD, MOST_SAMPLES = 16, 16, 200_000
#: Bytes of runs for a bucket, the least number of buckets, and ranges that they are parts of at most.
BUCKET_BYTES, LEAST_BUCKETS, MOST_RANGES = 8_000_000, 256, 4096
HOT_RUNS = 20_000
def check_lengths(length: int, gram: int) -> None:
    if not 8 <= gram <= length < 1 << 16:
        raise ValueError(f"needs 8 <= gram <= length < 65536, not gram {gram} and length {length}")


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(gram hash, row, anchor, first start, last start) of each run; places are those in the row.

    The buffer is worked on in pieces; a run that a piece's end splits is two runs, which changes nothing in the result.
    """
    window = length - gram + 1
    low = U64((1 << window.bit_length()) - 1)
    out = []
    for at in range(0, max(len(data) - length + 1, 0), PIECE):
        piece = data[at : at + PIECE + length - 1]
        rolling = Rolling(piece)
        place = np.arange(len(piece) - gram + 1)
        hashes = mix(rolling.raw(place, place + gram))
        # the leftmost smallest hash of each window, from the running minima of blocks to the right and to the left
        blocks = -(-len(hashes) // window)
        key = np.full(blocks * window, ~U64(0), U64)
        key[: len(hashes)] = hashes & ~low
        key = key.reshape(blocks, window) | np.arange(window, dtype=U64)
        after = np.minimum.accumulate(key, axis=1).ravel()
        before = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        start = np.arange(len(piece) - length + 1)
        one, two = before[: len(start)], after[window - 1 : window - 1 + len(start)]
        first = (one & ~low) <= (two & ~low)
        anchor = np.where(first, start // window * window + (one & low).astype(np.int64), (start + window - 1) // window * window + (two & low).astype(np.int64))
        row = np.searchsorted(offsets, start + at, side="right") - 1
        inside = start + at + length <= offsets[row + 1]
        start, anchor, row = start[inside], anchor[inside], row[inside]
        if not len(start):
            continue
        head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
        last = start[np.append(head[1:], len(start)) - 1]
        lo, a, r = start[head], anchor[head], row[head]
        base = at - offsets[r]
        out.append((hashes[a], r, a + base, lo + base, last + base))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (U64, *[np.int64] * 4))


#: The columns of packed rows, stored byte plane by byte plane: gram, its leading bytes where it is sampled (else 0), document,
#: anchor, anchor - first start, last - first start, and the number of runs that the row stands for, 2 for more than one.
GRAMS = (("gram", np.uint64), ("lead1", np.uint64), ("lead2", np.uint64), ("doc", np.uint32), ("anchor", np.uint32), ("before", np.uint16), ("span", np.uint16), ("times", np.uint8))
#: Those of runs with bytes; gram tells groups apart, and if it takes two for one that costs only time.
RUNS = (("gram", np.uint32), ("doc", np.uint32), ("lo", np.uint32), ("before", np.uint16), ("span", np.uint16))
SPANS = (("doc", np.uint32), ("lo", np.uint32), ("hi", np.uint32))


def _squeeze(data: bytes) -> bytes:
    """Rows are compressed before they are shuffled, as shuffles by default have no entropy coding."""
    return pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unsqueeze(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd", 1).decompress(data, size, asbytes=True)


def _pack(columns: dict[str, np.ndarray], layout) -> tuple[int, bool, bytes]:
    """(base of the documents, whether they need 64 bits, bytes)."""
    doc = columns["doc"]
    base = int(doc.min()) if len(doc) else 0
    wide = len(doc) > 0 and int(doc.max()) - base >= 1 << 32
    columns = columns | {"doc": doc if wide else doc - base}
    types = ((n, np.int64 if wide and n == "doc" else t) for n, t in layout)
    return base, wide, _squeeze(b"".join(np.ascontiguousarray(columns[n].astype(t).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T).tobytes() for n, t in types))


def _unpack(base: int, wide: bool, blob: bytes, rows: int, layout) -> dict[str, np.ndarray]:
    layout = [(n, np.int64 if wide and n == "doc" else t) for n, t in layout]
    blob = _unsqueeze(blob, rows * sum(np.dtype(t).itemsize for _, t in layout))
    out, at = {}, 0
    for n, t in layout:
        size = np.dtype(t).itemsize
        planes = np.frombuffer(blob, np.uint8, rows * size, at).reshape(size, rows)
        own = np.ascontiguousarray(planes.T).view(t).ravel()
        out[n], at = own if t == np.uint64 else own.astype(np.int64), at + rows * size
    if not wide:
        out["doc"] = out["doc"] + base
    return out


def _first_of_equal(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that differ from the row before in some key."""
    head = np.ones(len(keys[0]), bool)
    head[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return head


def _word(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number, the first byte highest."""
    out = np.zeros(len(place), U64)
    for k in range(8):
        out |= data[place + k].astype(U64) << U64(56 - 8 * k)
    return out


def gram_rows(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Rows (bucket, sure, base, wide, rows, blob) of packed anchor runs.

    Runs that share their gram with another one of the batch are sure to be looked at; one row per gram tells its bucket so.
    """

    def packed(parts):
        x = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
        order = np.argsort(x["gram"], kind="stable")
        x = {n: v[order] for n, v in x.items()}
        head = _first_of_equal(x["gram"])
        many = np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1] > 1
        x["times"] = np.where(many, 2, 1)
        out = []
        own = {n: v[head] for n, v in x.items()}
        cut = np.searchsorted(own["gram"], (np.arange(buckets + 1, dtype=object) * (1 << 64) // buckets).clip(0, (1 << 64) - 1).astype(U64))
        cut[-1] = len(own["gram"])
        parts = [(False, b, {n: v[cut[b] : cut[b + 1]] for n, v in own.items()}) for b in np.flatnonzero(np.diff(cut)).tolist()]
        # these go anywhere
        sure = {n: v[many] for n, v in x.items()}
        some = np.linspace(0, int(many.sum()), 9).astype(np.int64)
        shift = int(x["doc"][0]) % buckets
        parts += [(True, (shift + k) % buckets, {n: v[some[k] : some[k + 1]] for n, v in sure.items()}) for k in np.flatnonzero(np.diff(some)).tolist()]
        for is_sure, b, own in parts:
            base, wide, blob = _pack(own, GRAMS)
            out.append((b, is_sure, base, wide, len(own["gram"]), blob))
        types = (pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], ["bucket", "sure", "base", "wide", "rows", "blob"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            for part in slices(batch, "text", BYTES_AT_ONCE):
                data, offsets = text_bytes(part.column("text"))
                g, row, a, lo, hi = anchor_runs(data, offsets, length, gram)
                if not len(g):
                    continue
                g &= ~U64(0xFFFF)  # 48 bits find the grams that repeat nearly as well
                sampled = (g >> U64(24)) % U64(ONE_IN) == 0
                lead = np.zeros((2, len(g)), U64)
                padded = np.concatenate([data, np.zeros(LEAD, np.uint8)])
                lead[:, sampled] = [_word(padded, (offsets[row] + a)[sampled] + k) for k in (0, 8)]
                doc = np.array(part.column("doc_id"), np.int64)[row]
                parts.append({"gram": g, "lead1": lead[0], "lead2": lead[1], "doc": doc, "anchor": a, "before": a - lo, "span": hi - lo})
                n += len(g)
                if n >= RUNS_AT_ONCE:
                    yield packed(parts)
                    parts, n = [], 0
        if parts:
            yield packed(parts)

    return docs.mapInArrow(run, "bucket int, sure boolean, base long, wide boolean, rows int, blob binary")


def repeated_grams(rows: DataFrame) -> DataFrame:
    """(gram, lead, doc_id, place): the runs whose gram occurs in another run too, by its hash.

    lead are the gram's first bytes, for one gram in ONE_IN; place holds anchor, anchor - first start and last - first start
    in 32, 16 and 16 bits.
    """

    def emit(x, keep):
        leads = np.stack([x["lead1"][keep], x["lead2"][keep]], axis=1).astype(">u8")
        sampled = (x["gram"][keep] >> U64(24)) % U64(ONE_IN) == 0
        lead = pa.array([leads[i].tobytes() if s else None for i, s in enumerate(sampled.tolist())], pa.binary())
        place = (x["anchor"][keep] << 32) | (x["before"][keep] << 16) | x["span"][keep]
        return pa.RecordBatch.from_arrays([pa.array(x["gram"][keep].view(np.int64)), lead, pa.array(x["doc"][keep]), pa.array(place)], ["gram", "lead", "doc_id", "place"])

    def finish(parts):
        x = {n: np.concatenate([p[n] for p in parts]) for n, _ in GRAMS}
        order = np.argsort(x["gram"], kind="stable")
        x = {n: v[order] for n, v in x.items()}
        group = np.cumsum(_first_of_equal(x["gram"])) - 1
        times = np.bincount(group, weights=x["times"])[group]
        return emit(x, (times > 1) & (x["times"] == 1))

    def run(batches):
        bucket, parts = None, []
        for batch in batches:
            for r in batch.to_pylist():
                x = _unpack(r["base"], r["wide"], r["blob"], r["rows"], GRAMS)
                if r["sure"]:
                    yield emit(x, np.ones(r["rows"], bool))
                    continue
                if r["bucket"] != bucket and parts:
                    yield finish(parts)
                    parts = []
                bucket = r["bucket"]
                parts.append(x)
        if parts:
            yield finish(parts)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "gram long, lead binary, doc_id long, place long")


def multikey_groups(words, group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows by their words, of all groups side by side: (rows, group numbers) of the rows that have an equal.

    A partition is split three ways around the word of its middle row at its depth; the middle part goes on at the next
    depth. Partitions of one row are done, and so are those whose depth has passed their ``size`` in words; rows of one
    group and equal words have one size. ``words`` is called with row numbers and their depths.
    """
    rows = np.argsort(group, kind="stable")
    group = np.cumsum(_first_of_equal(group[rows])) - 1 if len(rows) else rows
    depth = np.zeros(group[-1] + 1 if len(rows) else 0, np.int64)
    done_rows, done_groups, n_done = [], [], 0
    while len(rows):
        many = np.bincount(group) > 1
        over = many & (depth >= size[rows[np.flatnonzero(_first_of_equal(group))]])
        if over.any():
            at = over[group]
            done_rows.append(rows[at])
            done_groups.append(np.unique(group[at], return_inverse=True)[1] + n_done)
            n_done += int(over.sum())
        at = (many & ~over)[group]
        rows, group = rows[at], group[at]
        if not len(rows):
            break
        head = _first_of_equal(group)
        depth, group = depth[group[head]], np.cumsum(head) - 1
        count = np.bincount(group)
        value = words(rows, depth[group])
        pivot = value[np.cumsum(count) - count + count // 2][group]
        side = (value >= pivot).astype(np.int64) + (value > pivot)
        key = group * 3 + side
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        head = _first_of_equal(key)
        depth, group = depth[key[head] // 3] + (key[head] % 3 == 1), np.cumsum(head) - 1
    if not done_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_rows), np.concatenate(done_groups)


def _later(rows: np.ndarray, group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of rows in groups of equal ones, all but the first of each by (document, start)."""
    order = np.lexsort((start[rows], doc[rows], group))
    rows, group = rows[order], group[order]
    return rows[~_first_of_equal(group)] if len(rows) else rows


def equal_runs(x: dict[str, np.ndarray], data: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Mask of the runs that have the bytes of an earlier one around the same gram; place is where a run's bytes begin in data."""
    shape, size = (x["before"].astype(U64) << U64(16)) | x["span"].astype(U64), x["span"] + length
    padded = np.concatenate([data, np.zeros(8, np.uint8)])

    def words(rows, depth):
        at = np.minimum(np.maximum(depth - 1, 0) * 8, size[rows] - 8)
        return np.where(depth == 0, shape[rows], _word(padded, place[rows] + at))

    found = multikey_groups(words, x["gram"], -(-size // 8) + 1)
    out = np.zeros(len(size), bool)
    out[_later(*found, x["doc"], x["lo"])] = True
    return out


def later_starts(x: dict[str, np.ndarray], data: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the starts whose string also starts earlier in the given runs, all of one gram or different ones."""
    size = x["span"] + 1
    run = np.repeat(np.arange(len(size)), size)
    start, at = ranges(x["lo"], size), ranges(place, size)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(len(data) + 1, U64)
    for k in range(8):
        eight |= padded[k : k + len(data) + 1].astype(U64) << U64(56 - 8 * k)
    offset = (x["before"][run] - (start - x["lo"][run])).astype(U64)

    def words(rows, depth):
        # strings around one gram can be equal only where they begin as far before it
        return np.where(depth == 0, offset[rows], eight[at[rows] + np.minimum(np.maximum(depth - 1, 0) * 8, length - 8)])

    found = multikey_groups(words, x["gram"][run], np.full(len(run), -(-length // 8) + 1))
    later = _later(*found, x["doc"][run], start)
    return x["doc"][run[later]], start[later]


def _spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    """(doc, lo, hi) put together where one ends right before the next."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return {"doc": doc, "lo": lo, "hi": hi}
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1)]))
    return {"doc": doc[head], "lo": lo[head], "hi": hi[np.append(head[1:], len(doc)) - 1]}


def _mixed(padded: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes at each place."""
    value = np.zeros(len(place), U64)
    for depth in range(0, length, 8):
        value = mix(value ^ _word(padded, place + min(depth, length - 8)))
    return value


def _single_starts(x: dict[str, np.ndarray], data: np.ndarray, place: np.ndarray, length: int):
    """The starts of runs as runs of their own, some at a time, grouped by a hash of their whole strings: (runs, places)."""
    size = x["span"] + 1
    run, start, at = np.repeat(np.arange(len(size)), size), ranges(x["lo"], size), ranges(place, size)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(0, len(run), STARTS_AT_ONCE):
        r, s, p = (v[k : k + STARTS_AT_ONCE] for v in (run, start, at))
        yield {"gram": _mixed(padded, p, length), "doc": x["doc"][r], "lo": s, "before": np.zeros(len(r), np.int64), "span": np.zeros(len(r), np.int64)}, p


def send_runs(rows: DataFrame, splitters: np.ndarray, parts: np.ndarray, length: int, gram: int) -> DataFrame:
    """Rows (bucket, settled, base, wide, rows, blob, bytes): runs for their buckets, and spans that repeat an earlier one of a batch.

    rows(doc_id, text, runs, hot) has the places of each text's runs, those of hot grams apart. Range k, before splitter k, is
    dealt by gram to ``parts[k]`` buckets.
    """
    first = np.cumsum(parts) - parts
    buckets = int(parts.sum())
    schema = ["bucket", "settled", "base", "wide", "rows", "blob", "bytes"]
    types = (pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())

    def sent(x, data, place, bucket):
        """One row for each bucket."""
        order = np.lexsort((x["gram"], bucket))
        bucket, place, x = bucket[order], place[order], {n: v[order] for n, v in x.items()}
        size = x["span"] + length
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = _squeeze(data[ranges(place[a:b], size[a:b])].tobytes())
            out.append((int(bucket[a]), False, *_row({n: v[a:b] for n, v in x.items()}, RUNS), own))
        return out

    def ranged(x, data, place):
        """The bucket of each run: the range of the leading bytes of its gram, and a part of it by the gram."""
        padded, at = np.concatenate([data, np.zeros(LEAD, np.uint8)]), place + x["before"]
        leads = np.stack([_word(padded, at + k) for k in (0, 8)], axis=1).astype(">u8").view(f"S{LEAD}").ravel()
        own = np.searchsorted(splitters, leads, side="right")
        return first[own] + (mix(x["gram"]) % parts[own].astype(U64)).astype(np.int64)

    def _row(x, layout):
        base, wide, blob = _pack(x, layout)
        return base, wide, len(x["doc"]), blob

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SORTED_AT_ONCE):
                data, offsets = text_bytes(part.column("text"))
                lists = [part.column(n) for n in ("runs", "hot")]
                row = np.concatenate([np.repeat(np.arange(part.num_rows), np.array(x.value_lengths(), np.int64)) for x in lists])
                if not len(row):
                    continue
                at = np.concatenate([np.array(x.flatten(), np.int64) for x in lists])
                hot = np.arange(len(at)) >= len(lists[0].flatten())
                before, span = (at >> 16) & 0xFFFF, at & 0xFFFF
                lo = (at >> 32) - before
                hi = lo + span
                place = offsets[row] + lo
                x = {"gram": _mixed(np.concatenate([data, np.zeros(8, np.uint8)]), place + before, gram), "doc": np.array(part.column("doc_id"), np.int64)[row], "lo": lo, "before": before, "span": span}
                known = equal_runs(x, data, place, length)
                spans = _spans(x["doc"][known], lo[known], hi[known])
                out = []
                if len(spans["doc"]):
                    out.append((int(spans["doc"][0]) % buckets, True, *_row(spans, SPANS), b""))
                keep = ~known & ~hot
                own = {n: v[keep] for n, v in x.items()}
                out += sent(own, data, place[keep], ranged(own, data, place[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [()] * 7, types, strict=True)], schema)
                keep = ~known & hot
                for own, at in _single_starts({n: v[keep] for n, v in x.items()}, data, place[keep], length):
                    known = equal_runs(own, data, at, length)
                    spans = _spans(own["doc"][known], own["lo"][known], own["lo"][known])
                    out = [(int(spans["doc"][0]) % buckets, True, *_row(spans, SPANS), b"")] if known.any() else []
                    own = {n: v[~known] for n, v in own.items()}
                    out += sent(own, data, at[~known], (own["gram"] % U64(buckets)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], schema)

    return rows.mapInArrow(run, "bucket int, settled boolean, base long, wide boolean, rows int, blob binary, bytes binary")


def sort_buckets(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, lo, hi): the starts whose strings start earlier, from the rows of ``send_runs``."""

    def spans(x):
        return pa.RecordBatch.from_arrays([pa.array(x["doc"]), *(pa.array(x[n].astype(np.int32)) for n in ("lo", "hi"))], ["doc_id", "lo", "hi"])

    def finish(parts):
        x = {n: np.concatenate([p[n] for p, _ in parts]) for n, _ in RUNS}
        size = x["span"] + length
        data = np.frombuffer(b"".join(_unsqueeze(b, int(p["span"].sum()) + length * len(p["span"])) for p, b in parts), np.uint8)
        place = np.cumsum(size) - size
        known = equal_runs(x, data, place, length)
        yield spans(_spans(x["doc"][known], x["lo"][known], (x["lo"] + x["span"])[known]))
        x, place = {n: v[~known] for n, v in x.items()}, place[~known]
        order = np.argsort(x["gram"], kind="stable")
        group = np.cumsum(_first_of_equal(x["gram"][order])) - 1
        many = np.bincount(group, minlength=1)[group] > 1
        order, group = order[many], group[many]
        # strings of different grams differ: whole groups go together, about SORTED_STARTS at a time
        starts = np.cumsum(x["span"][order] + 1)
        at = 0
        while at < len(order):
            to = int(np.searchsorted(starts, starts[at] + SORTED_STARTS))
            to = int(np.searchsorted(group, group[min(to, len(order) - 1)], side="right"))
            own = order[at:to]
            used = ranges(place[own], x["span"][own] + length)
            sizes = x["span"][own] + length
            doc, start = later_starts({n: v[own] for n, v in x.items()}, data[used], np.cumsum(sizes) - sizes, length)
            yield spans(_spans(doc, start, start))
            at = to

    def run(batches):
        bucket, parts = None, []
        for batch in batches:
            for r in batch.to_pylist():
                x = _unpack(r["base"], r["wide"], r["blob"], r["rows"], SPANS if r["settled"] else RUNS)
                if r["settled"]:
                    yield spans(x)
                    continue
                if r["bucket"] != bucket and parts:
                    yield from finish(parts)
                    parts = []
                bucket = r["bucket"]
                parts.append((x, r["bytes"]))
        if parts:
            yield from finish(parts)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, lo int, hi int")


def splitters_of(runs: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(splitters, parts of each range): quantiles of the sampled leading bytes, for buckets of about BUCKET_BYTES.

    Leading bytes that many grams have, as those of a common heading, are several quantiles: as a splitter they count once, and
    the range that they begin has so many times the parts.
    """
    total = runs.agg(F.sum(F.col("place").bitwiseAND(0xFFFF) + length).alias("size"), F.count("lead").alias("sampled")).first()
    n = max(LEAST_BUCKETS, (total["size"] or 0) // BUCKET_BYTES)
    each = -(-n // MOST_RANGES)
    one_in = -(-total["sampled"] // MOST_SAMPLES)
    sample = runs.where("lead is not null")
    if one_in > 1:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", "place"), F.lit(one_in)) == 0)
    leads = np.sort(np.array([bytes(r["lead"]) for r in sample.select("lead").collect()], f"S{LEAD}"))
    if not len(leads):
        return leads, np.array([each])
    splitters, times = np.unique(leads[np.arange(1, n // each) * len(leads) // (n // each)], return_counts=True)
    return splitters, np.concatenate([[1], times]) * each


def removed_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, lo, hi): the starts whose string also starts earlier, as runs that may meet or overlap.

    docs(doc_id, text) must have distinct doc_ids that are not NULL.
    """
    check_lengths(length, gram)
    buckets = max(LEAST_BUCKETS, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = materialize(repeated_grams(gram_rows(docs, buckets, length, gram)), "runs", compression="zstd")
    splitters, parts = splitters_of(runs, length)
    hot = materialize(runs.groupBy("gram").count().where(F.col("count") > hot_runs).select("gram", F.lit(True).alias("hot")), "hot_grams")
    marked = runs.join(hot, "gram", "left")
    per_doc = marked.groupBy("doc_id").agg(F.collect_list(F.when(F.col("hot").isNull(), F.col("place"))).alias("runs"), F.collect_list(F.when(F.col("hot"), F.col("place"))).alias("hot"))
    rows = docs.join(per_doc, "doc_id").select("doc_id", "text", "runs", "hot")
    return sort_buckets(send_runs(rows, splitters, parts, length, gram), length)


def _with_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with a distinct key, the column ``name``, in order of (doc_id, text); NULL where the doc_id is.

    It is the doc_id itself where no two rows share one.
    """
    if not docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").take(1):
        return docs.withColumn(name, F.col("doc_id"))
    ordered = docs.orderBy("doc_id", "text").withColumn(name, F.monotonically_increasing_id())
    return materialize(ordered.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.col(name))), "keyed")


def _spans_by_key(usable: DataFrame, length: int, gram: int, hot_runs: int, name: str) -> DataFrame:
    """(doc_id, the removed (first start, last start) runs) of the documents that have some."""
    starts = removed_starts(usable, length, gram, hot_runs)
    return starts.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias(name))


def _cut(data: np.ndarray, spans: list | None, length: int) -> tuple[np.ndarray, int]:
    """(mask of removed bytes, number of maximal removed runs)."""
    if not spans:
        return np.zeros(len(data), bool), 0
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, [s["lo"] for s in spans], 1)
    np.add.at(step, [s["hi"] + length for s in spans], -1)
    gone = np.cumsum(step)[:-1] > 0
    return gone, int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256."""
    keyed = _with_key(docs.select("doc_id", "text"), "key")
    # the same two columns here and in removed_starts, so that both joins read one shuffle of the texts
    usable = keyed.where(F.col("key").isNotNull()).select(F.col("key").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = usable.join(_spans_by_key(usable, length, gram, hot_runs, "spans"), "doc_id", "left")
    if keyed.where(~F.col("doc_id").eqNullSafe(F.col("key"))).take(1):
        rows = rows.withColumnRenamed("doc_id", "key").join(keyed.select("key", "doc_id"), "key")
    loose = keyed.where(F.col("key").isNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", "spans").unionByName(loose, allowMissingColumns=True)

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = (text.as_py() or "").encode()
                spans = spans.as_py()
                if spans:
                    data = np.frombuffer(raw, np.uint8)
                    gone, n = _cut(data, spans, length)
                    kept = data[~gone].tobytes()
                else:
                    kept, n = raw, 0
                out.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            columns = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def cut(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """docs with the repeated passages cut out of ``text``; every row stays, and so does a NULL text."""
    key, spans_name = unused(docs, "suffix_key", "removed_spans")
    keyed = _with_key(docs, key)
    usable = keyed.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = keyed.join(_spans_by_key(usable, length, gram, hot_runs, spans_name).withColumnRenamed("doc_id", key), key, "left")
    names = [f.name for f in docs.schema]

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text"), batch.column(spans_name), strict=True):
                value, spans = text.as_py(), spans.as_py()
                if spans:
                    data = np.frombuffer(value.encode(), np.uint8)
                    gone = _cut(data, spans, length)[0]
                    heads = np.flatnonzero((data & 0xC0) != 0x80)
                    broken = np.logical_or.reduceat(gone, heads)
                    value = data[~np.repeat(broken, np.diff(np.append(heads, len(data))))].tobytes().decode()
                texts.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.select(*names, spans_name).mapInArrow(run, schema)


def query(spark, sf_dir):
    return repeats(spread(table(spark, sf_dir, "documents")))
