"""Numpy kernels over the bytes of Arrow text columns, for use inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty. Row i is bytes[offsets[i]:offsets[i + 1]]."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text, so that arrays over the bytes stay small.

    A row longer than that comes alone.
    """
    _, offsets = text_bytes(batch.column(name))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    out = np.empty(max(n, 1), U64)
    out[0] = 1
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * U64(pow(base, have, 1 << 64))
        have += step
    return out[:n]


#: An odd base and its inverse modulo 2 ** 64, and a random value for each byte: fixed, so hashes agree everywhere.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


class Rolling:
    """Hashes of any byte ranges of a buffer from one prefix sum."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTES):
        self.inverse = _powers(INVERSE, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, U64)
        np.cumsum(table[data] * _powers(BASE, len(data)), out=self.prefix[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scrambled hash of bytes[start:end]; ranges of different length differ too."""
        return mix(self.raw(start, end) + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


#: A prime below 2 ** 31, so that products of residues fit 64 bits, and a base that is no small power of another.
PRIME = (1 << 31) - 1
PRIME_BASE = 1_103_515_245


def _residues(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo PRIME."""
    out = np.ones(max(n, 1), U64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * U64(pow(base, have, PRIME)) % U64(PRIME)
        have += step
    return out[:n]


class Residues:
    """Hashes of any byte ranges modulo a prime.

    Sums modulo 2 ** 64 have texts that agree whatever the odd base (the Thue-Morse word of 1,024 letters and its complement);
    modulo a prime those differ, so both together tell them apart.
    """

    def __init__(self, data: np.ndarray):
        self.inverse = _residues(pow(PRIME_BASE, -1, PRIME), len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * _residues(PRIME_BASE, len(data)) % U64(PRIME), out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) % U64(PRIME) * self.inverse[start] % U64(PRIME)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): the words of all rows, and the index of each row's first word (with the total at the end).

    Words are maximal runs without ASCII white space; they do not cross rows.
    """
    space = np.ones(len(data) + 1, bool)
    space[:-1] = IS_SPACE[data]
    head = ~space[:-1]
    starts = head.copy()
    starts[1:] &= space[:-2]
    edges = offsets[1:-1][(offsets[1:-1] < len(data))]
    starts[edges] |= head[edges]
    start = np.flatnonzero(starts)
    last = head.copy()
    last[:-1] &= space[1:-1]
    before = edges[edges > 0] - 1
    last[before] |= head[before]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of start[i] ... start[i] + length[i] - 1."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.repeat(start - first, length) + np.arange(total)
