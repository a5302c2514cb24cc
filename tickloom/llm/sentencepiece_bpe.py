"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts become flat numpy arrays of symbols. They are cut where no piece of the vocabulary holds two neighbouring characters,
which no merge can cross; equal words, as these runs are called here, are encoded once per batch and kept in a bounded
cache. In a round every word finds its smallest pair rank by a segmented minimum and merges that pair, leftmost first; then
the arrays are compacted. All places of the pair in a word merge in the same round unless a pair that this makes ranks as
low: then only the leftmost does, which is the order of the library's queue. Rounds end when no pair remains.

The model must be BPE without normalisation of characters (identity); byte fallback, a dummy blank at the start and escaped
blanks are supported. Edge cases: NULL and empty texts have no ids and decode to the empty text; repeated rows and extra
columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from tickloom.llm.common import spread, table
from tickloom.llm.kernels import BASE, U64, _powers, mix, ranges, slices

BLANK = "▁"
NEVER = np.int32(2**31 - 1)
#: Bytes of text that are encoded at a time (its arrays take about 50 bytes for each, which the Python worker keeps for later
#: tasks), and words that the cache of a task holds at most.
BYTES_AT_ONCE, CACHED_WORDS = 500_000, 400_000
#: Code points of those words that it keeps to tell words apart.
CACHED_CHARACTERS = 20_000_000


class Model:
    """Lookup tables of a SentencePiece BPE model.

    A symbol is a piece or a single character of one; characters outside the vocabulary get symbols below zero and never
    merge.
    """

    def __init__(self, serialized: bytes):
        proto = pb.ModelProto()
        proto.ParseFromString(serialized)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models without normalisation are supported")
        self.dummy = norm.add_dummy_prefix
        kinds = pb.ModelProto.SentencePiece
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        fallback = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_ids = np.array([fallback[b] for b in range(256)], np.int32) if train.byte_fallback else None
        symbols = dict(normal)
        for char in sorted({c for p in normal for c in p} - symbols.keys()):
            symbols[char] = len(proto.pieces) + len(symbols) - len(normal)
        self.n_pieces = len(proto.pieces)
        # ranks: equal scores share one, higher scores come first
        order = {s: k for k, s in enumerate(sorted({proto.pieces[i].score for i in normal.values()}, reverse=True))}
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = (order[proto.pieces[i].score], i)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_keys.tolist()], np.int32)
        self.pair_id = np.array([pairs[k][1] for k in self.pair_keys.tolist()], np.int32)
        # characters: a small number for each that is in a piece, 0 for all others
        chars = sorted({c for p in normal for c in p})
        self.char_class = np.zeros(0x110000, np.uint16)
        self.char_class[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.class_symbol = np.array([-1, *(symbols[c] for c in chars)], np.int32)
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for piece in normal:
            c = self.char_class[[ord(x) for x in piece]]
            self.joins[c[:-1], c[1:]] = True
        # decoding: the bytes of each id, blanks in place of the mark
        surface = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else (train.unk_surface.encode() if p.type == kinds.UNKNOWN else p.piece.replace(BLANK, " ").encode()) for p in proto.pieces]
        self.surface_length = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.is_byte = np.array([p.type == kinds.BYTE for p in proto.pieces])
        self.opens_blank = np.array([p.type == kinds.NORMAL and p.piece.startswith(BLANK) for p in proto.pieces])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; NEVER where they do not merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], NEVER), self.pair_id[at]


def merge_rounds(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of words (given one after another, with their lengths) until no pair remains.

    Returns the ids of all words and their new lengths.
    """
    done_ids: list[np.ndarray] = []
    done_words: list[np.ndarray] = []
    done_lengths: list[np.ndarray] = []
    word, sym, size = np.arange(len(lengths)), symbols.astype(np.int32), lengths.astype(np.int64)
    first = np.cumsum(size) - size
    rank = np.full(len(sym), NEVER, np.int32)  # of the pair that starts here
    made = np.zeros(len(sym), np.int32)
    rank[:-1], made[:-1] = model.ranks(sym[:-1], sym[1:])
    if len(sym):
        rank[first + size - 1] = NEVER
    while len(word):
        low = np.minimum.reduceat(rank, first)
        live = low < NEVER
        if not live.all():
            over = np.repeat(~live, size)
            done_ids.append(sym[over])
            done_words.append(word[~live])
            done_lengths.append(size[~live])
            sym, rank, made = sym[~over], rank[~over], made[~over]
            word, size, low = word[live], size[live], low[live]
            first = np.cumsum(size) - size
            if not len(word):
                break
        owner = np.repeat(np.arange(len(word)), size)
        at = np.flatnonzero(rank == low[owner])
        # leftmost places that do not overlap: every other one in a run of neighbours of the same word
        run = np.ones(len(at), bool)
        run[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
        head = np.flatnonzero(run)
        at = at[(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0]
        who = owner[at]
        opens = np.ones(len(at), bool)
        opens[1:] = who[1:] != who[:-1]
        # words with several places: is a pair made on the way that ranks as low?
        if not opens.all():
            new = made[at]
            left_ok = (at > first[who])
            before = np.where(left_ok, sym[np.maximum(at - 1, 0)], -1)
            chained = np.zeros(len(at), bool)
            chained[1:] = (at[1:] == at[:-1] + 2) & ~opens[1:]
            before = np.where(chained, np.append(-1, new[:-1]), before)
            right_ok = at + 2 < first[who] + size[who]
            after = np.where(right_ok, sym[np.minimum(at + 2, len(sym) - 1)], -1)
            risk = np.minimum(model.ranks(before, new)[0], model.ranks(new, after)[0]) <= low[who]
            unsafe = np.zeros(len(word), bool)
            unsafe[who[risk]] = True
            at = at[opens | ~unsafe[who]]
            who = owner[at]
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        size = size - np.bincount(who, minlength=len(word))
        moved = np.cumsum(keep) - 1
        at = moved[at]
        sym, rank, made = sym[keep], rank[keep], made[keep]
        first = np.cumsum(size) - size
        end = first + size - 1
        # pairs next to a merge change
        touched = np.concatenate([at, at[at > first[who]] - 1])
        last = np.zeros(len(sym), bool)
        last[end] = True
        rank[touched], made[touched] = model.ranks(sym[touched], sym[np.minimum(touched + 1, len(sym) - 1)])
        rank[touched[last[touched]]] = NEVER
    if not done_words:
        return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
    order = np.concatenate(done_words)
    got = np.concatenate(done_lengths)
    ids = np.concatenate(done_ids)
    start = np.cumsum(got) - got
    back = np.empty(len(lengths), np.int64)
    back[order] = np.arange(len(order))
    return ids[ranges(start[back], got[back])], got[back]


def unlike(code: np.ndarray, start: np.ndarray, length: np.ndarray, code2: np.ndarray, start2: np.ndarray, length2: np.ndarray) -> np.ndarray:
    """Which words of one array of code points differ from their partners in another; no word is empty."""
    out = length != length2
    same = np.flatnonzero(~out & ((start != start2) | (code is not code2)))
    if len(same):
        n = length[same]
        differs = code[ranges(start[same], n)] != code2[ranges(start2[same], n)]
        out[same] = np.logical_or.reduceat(differs, np.cumsum(n) - n)
    return out


class Encoder:
    """Encodes batches of texts, keeping the ids of words seen before up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, U64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)
        self.spelt_at = np.zeros(0, np.int64)
        self.spelt = np.zeros(0, np.int64)
        self.spelling = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        m = self.model
        marked = [((BLANK if m.dummy else "") + t.replace(" ", BLANK)) if t else "" for t in texts]
        code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        kind = m.char_class[code]
        cut = np.ones(len(code), bool)
        cut[1:] = ~m.joins[kind[:-1], kind[1:]]
        edge = np.cumsum(sizes)
        cut[edge[edge < len(code)]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(code)))
        # words by hash: the sum over code points times powers of an odd base, from the word's start
        value = mix(code.astype(U64) + U64(1)) * _powers(BASE, int(length.max()))[np.arange(len(code)) - np.repeat(start, length)]
        keys = mix(np.add.reduceat(value, start) + length.astype(U64))
        unique, place, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > CACHED_WORDS or len(self.spelling) + int(length[place].sum()) > CACHED_CHARACTERS:
            self.clear()
        while True:
            other = self._unlike(unique, start[place], length[place], code)[which]
            first = place[which]
            other |= unlike(code, start, length, code, start[first], length[first])
            if not other.any():
                break
            # a hash is no proof: a word that is spelt otherwise than the one that has its key takes the next key
            keys[other] = mix(keys[other] + U64(1))
            unique, place, which = np.unique(keys, return_index=True, return_inverse=True)
        self._learn(unique, start[place], length[place], code, kind)
        at = np.searchsorted(self.keys, unique)[which]
        count = self.length[at]
        ids = self.pool[ranges(self.start[at], count)]
        text_of = np.searchsorted(edge, start, side="right")
        return ids, np.bincount(text_of, weights=count, minlength=len(texts)).astype(np.int64)

    def _known(self, unique) -> tuple[np.ndarray, np.ndarray]:
        """(place, known) of keys among those of words seen before."""
        if not len(self.keys):
            return np.zeros(len(unique), np.int64), np.zeros(len(unique), bool)
        at = np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)
        return at, self.keys[at] == unique

    def _unlike(self, unique, start, length, code) -> np.ndarray:
        """Which words are spelt otherwise than the word seen before that has their key."""
        at, known = self._known(unique)
        out = np.zeros(len(unique), bool)
        at = at[known]
        out[known] = unlike(code, start[known], length[known], self.spelling, self.spelt_at[at], self.spelt[at])
        return out

    def _learn(self, unique, start, length, code, kind) -> None:
        _, known = self._known(unique)
        if known.all():
            return
        m, start, length = self.model, start[~known], length[~known]
        flat = ranges(start, length)
        sym = m.class_symbol[kind[flat]]
        ids, count = merge_rounds(m, sym, length)
        ids, count = self._outside(ids, count, code[flat], length)
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(count) - count])
        self.length = np.concatenate([self.length, count])
        self.pool = np.concatenate([self.pool, ids])
        self.spelt_at = np.concatenate([self.spelt_at, len(self.spelling) + np.cumsum(length) - length])
        self.spelt = np.concatenate([self.spelt, length])
        self.spelling = np.concatenate([self.spelling, code[flat]])
        self.keys = np.concatenate([self.keys, unique[~known]])
        order = np.argsort(self.keys, kind="stable")
        for name in ("keys", "start", "length", "spelt_at", "spelt"):
            setattr(self, name, getattr(self, name)[order])

    def _outside(self, ids, count, code, length):
        """Replace symbols that are no piece by byte ids or the unknown id.

        A character outside every piece is a word of its own, as no pair joins it to its neighbours; one that is inside
        pieces but none itself may be left over among others.
        """
        m = self.model
        odd = (ids < 0) | (ids >= m.n_pieces)
        if not odd.any():
            return ids, count
        word = np.repeat(np.arange(len(count)), count)
        first = np.cumsum(length) - length
        extra = {int(m.class_symbol[m.char_class[c]]): c for c in set(code.tolist()) if m.class_symbol[m.char_class[c]] >= m.n_pieces}
        char = [int(code[first[w]]) if s < 0 else extra[s] for w, s in zip(word[odd].tolist(), ids[odd].tolist(), strict=True)]
        new = [m.byte_ids[list(chr(c).encode("utf-8", "replace"))] if m.byte_ids is not None else np.array([m.unknown]) for c in char]
        grown = np.ones(len(ids), np.int64)
        grown[odd] = [len(x) for x in new]
        out = np.repeat(ids, grown)
        out[np.repeat(odd, grown)] = np.concatenate(new)
        return out, np.bincount(word, weights=grown, minlength=len(count)).astype(np.int64)


def decode(model: Model, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of id sequences given one after another, with the number of ids of each.

    Bytes that are no UTF-8 come out as one replacement character each, as in the library.
    """
    lengths = model.surface_length[ids]
    data = model.surface[ranges(model.surface_start[ids], lengths)].tobytes()
    ends = np.cumsum(lengths)
    last = np.cumsum(counts)
    out, at = [], 0
    for n, e in zip(counts.tolist(), last.tolist(), strict=True):
        to = int(ends[e - 1]) if n else at
        strip = 1 if n and model.dummy and model.opens_blank[ids[e - n]] else 0
        piece = data[at + strip : to]
        try:
            out.append(piece.decode())
        except UnicodeDecodeError:
            out.append(_lenient(model, ids[e - n : e], strip))
        at = to
    return out


def _lenient(model: Model, ids: np.ndarray, strip: int) -> str:
    """Decoding of ids whose bytes are not all UTF-8: runs of byte ids are repaired on their own."""
    out, run = [], bytearray()

    def flush() -> None:
        left = bytes(run)
        run.clear()
        while left:
            for size in (1, 2, 3, 4):
                try:
                    out.append(left[:size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            left = left[size:]

    for i in ids.tolist():
        piece = model.surface[model.surface_start[i] : model.surface_start[i] + model.surface_length[i]].tobytes()
        if model.is_byte[i]:
            run += piece
        else:
            flush()
            out.append(piece.decode())
    flush()
    return "".join(out)[strip:]


_models: dict[bytes, Encoder] = {}


def encoder(serialized: bytes) -> Encoder:
    """The encoder of a model, once per Python worker."""
    key = hashlib.sha256(serialized).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Encoder(Model(serialized))
    return _models[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_texts(serialized: bytes, batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, counts) for slices of a batch with a bounded number of bytes."""
    enc = encoder(serialized)
    for part in slices(batch, text_col, BYTES_AT_ONCE):
        ids, counts = enc.encode([t or "" for t in part.column(text_col).to_pylist()])
        yield part, ids, counts


def encode_column(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds the ids of a text column as array<int>."""
    serialized = read_model(model_path)

    def run(batches):
        for batch in batches:
            for part, ids, counts in encode_texts(serialized, batch, text_col):
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                kept = [n for n in part.schema.names if n != out_col]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), lists], [*kept, out_col])

    rest = df.drop(out_col)
    return rest.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{out_col}` array<int>"]))


def count_column(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens", drop_text: bool = True) -> DataFrame:
    """Adds the number of ids of a text column; drops the text unless told otherwise."""
    serialized = read_model(model_path)
    rest = df.drop(out_col)
    kept = [f for f in rest.schema if not drop_text or f.name != text_col]

    def run(batches):
        for batch in batches:
            for part, _, counts in encode_texts(serialized, batch, text_col):
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(counts)], [*(f.name for f in kept), out_col])

    return rest.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out_col}` bigint"]))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: n_tokens, the digest of its ids in decimal, joined by commas, and of the text that they decode to."""
    serialized = read_model(model_path)

    def run(batches):
        for batch in batches:
            for part, ids, counts in encode_texts(serialized, batch, "text"):
                decoded = decode(encoder(serialized).model, ids, counts)
                numbers = list(map(str, ids.tolist()))
                ends = np.cumsum(counts).tolist()
                joined = [",".join(numbers[e - n : e]) for n, e in zip(counts.tolist(), ends, strict=True)]
                sha = lambda xs: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), sha(joined), sha(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir):
    import public_tokenizers

    return digests(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model"))
