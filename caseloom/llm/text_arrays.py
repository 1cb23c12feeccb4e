"""Words and hashes of Arrow text columns, as numpy arrays over their UTF-8 bytes.

A text column of an Arrow batch is one buffer of bytes and one of offsets, so
that words, their hashes and the hashes of word runs are a few array operations
for a whole slice of documents and nothing is done for each word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space and U+0009 to U+000D.
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text handled at once; a single longer document makes a longer slice.
SLICE = 1 << 20
#: Places of a word whose bytes have a table of their own; later ones mix the place in.
PLACES = 64


def _scramble(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers out of the counter ``seed``, ``seed`` + 1, ..."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


#: A number for each place and byte, by lane: a word's hash is the sum of its bytes' numbers (tabulation hashing), so
#: that no two words collide by their structure, as they do with powers of one base modulo 2^64.
_TABLES = [_scramble(PLACES * 256, 1_000_000 * (lane + 1)).reshape(PLACES, 256) for lane in range(2)]
_LOWER = [t.copy() for t in _TABLES]
for _t in _LOWER:
    _t[:, 65:91] = _t[:, 97:123]
_PAIR = [(np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))]


def _pair(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """A hash of two runs of words, one after the other or overlapping, from those of each."""
    x, y = _PAIR[lane]
    return finish(a * x + ((b >> np.uint64(33)) | (b << np.uint64(31))) * y)


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1, lo + 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of a slice: byte ``start`` and ``end`` of each, and ``first``, the
    number of the first word of every row (one more entry than rows)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        gap = _BREAK[buf]
        ink = ~gap
        begin, stop = ink.copy(), ink.copy()
        begin[1:] &= gap[:-1]
        stop[:-1] &= gap[1:]
        full = offs[1:] > offs[:-1]
        head, tail = offs[:-1][full], offs[1:][full] - 1
        begin[head], stop[tail] = ink[head], ink[tail]
        self.buf = buf
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self._ink: tuple[np.ndarray, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lane: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` reads A-Z as a-z."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        table = (_LOWER if lower else _TABLES)[lane]
        size = self.end - self.start
        head = np.cumsum(size) - size
        if self._ink is None:  # the words' bytes and their places, which both lanes read
            ink = self.buf[~_BREAK[self.buf]]
            self._ink = ink, np.arange(len(ink), dtype=np.int32) - np.repeat(head.astype(np.int32), size)
        ink, place = self._ink
        values = table.ravel()[(np.minimum(place, PLACES - 1) << 8) | ink]
        if len(far := np.flatnonzero(place >= PLACES)):
            values[far] = finish(finish(values[far] + place[far].astype(np.uint64) * _PAIR[lane][0]) + place[far].astype(np.uint64))
        return finish(np.add.reduceat(values, head) + size.astype(np.uint64) * _PAIR[lane][1])

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def holds(self, n: int) -> np.ndarray:
        """Whether ``n`` words from each word on lie in its row."""
        return np.arange(len(self)) + n <= np.repeat(self.first[1:], self.count)


class Runs:
    """Hashes of runs of words. Those of 2, 4, 8, ... words are made of two halves; any
    other run is two such runs that overlap."""

    def __init__(self, hashes: np.ndarray, lane: int = 0):
        self.lane = lane
        self._levels = [hashes]

    def _level(self, k: int) -> np.ndarray:
        while len(self._levels) <= k:
            last, half = self._levels[-1], 1 << (len(self._levels) - 1)
            self._levels.append(_pair(last[: max(0, len(last) - half)], last[half:], self.lane))
        return self._levels[k]

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The hash of the words from each ``lo`` up to ``hi``, at least one."""
        n = hi - lo
        out = np.empty(len(lo), np.uint64)
        power = np.frexp(n.astype(np.float64))[1] - 1
        for k in np.unique(power):
            own = np.flatnonzero(power == k)
            level = self._level(int(k))
            out[own] = _pair(level[lo[own]], level[hi[own] - (1 << int(k))], self.lane)
        return finish(out + n.astype(np.uint64))

    def all(self, n: int) -> np.ndarray:
        """The hash of the ``n`` words from each word on, rows ignored."""
        k = n.bit_length() - 1
        level, count = self._level(k), max(0, len(self._levels[0]) - n + 1)
        shift = n - (1 << k)
        return finish(_pair(level[:count], level[shift : shift + count], self.lane) + np.uint64(n))
