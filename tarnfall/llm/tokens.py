"""Words, 64-bit word hashes and n-gram hashes of Arrow string columns, in numpy.

Texts are handled as UTF-8 bytes. A byte table lower-cases A-Z and marks
separators, so no text is split into Python strings. Hashes are equal for equal
byte strings on every machine and in every run; two different words of a corpus
of a million million words share one with a probability far below 10**-6 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = frozenset([0x20, *range(0x09, 0x0E)])
#: Bytes of text handled at once; one longer text is handled alone.
SLICE = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15 | 3)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def byte_table(separators: frozenset[int]) -> np.ndarray:
    """Maps A-Z to lower case and every separator to 0x20."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    table[sorted(separators)] = 0x20
    return table


WHITE = byte_table(SPACE)
#: Separators of license words: all ASCII but digits and letters.
NOT_WORD = byte_table(frozenset([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """Words of consecutive texts: start and end bytes, the text's row, its first word."""

    __slots__ = ("data", "start", "end", "row", "first", "n", "sums")

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, table: np.ndarray = WHITE):
        self.data = data = table[raw]
        self.sums: np.ndarray | None = None
        self.n = len(offsets) - 1
        inside = data != 0x20
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside))  # before[i]: byte i-1 is inside
        self.start = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
        after = np.concatenate((inside, [False]))
        self.end = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
        #: first[r] is the index of row r's first word; first[n] is the word count.
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(self.n), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def _between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.data)
        up, down = _power_tables(n + 1)
        if self.sums is None:
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[:n], out=self.sums[1:])
        h = (self.sums[end] - self.sums[start]) * down[start]
        return mix(h + (end - start).astype(np.uint64) * _MULT)

    def hashes(self) -> np.ndarray:
        return self._between(self.start, self.end)

    def prefix_hashes(self, size: int, which: np.ndarray) -> np.ndarray:
        """Hashes of the first ``size`` bytes of some words."""
        start = self.start[which]
        return self._between(start, start + size)

    def taken(self, which: np.ndarray) -> "Words":
        """The same bytes with some of the words only; rows are lost."""
        out = object.__new__(Words)
        out.data, out.sums, out.n = self.data, self.sums, 0
        out.start, out.end, out.row, out.first = self.start[which], self.end[which], self.row[which], None
        return out


def word_hash(word: bytes) -> int:
    return int(Words(np.array([0, len(word)]), np.frombuffer(word, np.uint8)).hashes()[0])


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values of h: len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, np.uint64(n * int(_MULT) % (1 << 64)))
    for k in range(n):
        out *= _BASE
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes: k words, or all words if there are fewer."""
    h, first = words.hashes(), words.first
    grams = gram_hashes(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(np.unique(grams[a : b - k + 1]) if b - a >= k else gram_hashes(h[a:b], b - a) if b > a else h[:0])
    return out
