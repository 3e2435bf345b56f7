"""Vectorised word and n-gram hashing over the bytes of Arrow string columns.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; in UTF-8 these bytes never occur inside
another character, so working on bytes equals working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_SECOND_BASE = 0xA0761D6478BD642F
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text hashed at once; bounds the working arrays, except that one longer text is taken whole.
SLICE_BYTES = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 8 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, from one prefix sum."""
    n = len(values)
    total = np.zeros(n + 1, U)
    np.cumsum(values * powers(base, n), out=total[1:])
    inverse = pow(base, -1, 1 << 64)
    return (total[ends] - total[starts]) * powers(inverse, n + 1)[starts]


class Texts:
    """The bytes of a slice of texts; a null text is empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.data = raw[offsets[0] : offsets[-1]]
        if lower:
            self.data = np.where((self.data >= 65) & (self.data <= 90), self.data + 32, self.data).astype(np.uint8)
        self.starts = offsets[:-1] - offsets[0]
        self.ends = offsets[1:] - offsets[0]

    def __len__(self) -> int:
        return len(self.starts)

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


class Words:
    """Word boundaries, 64-bit word hashes and, per text, the range of its words."""

    def __init__(self, texts: Texts):
        data = texts.data
        inside = ~SEPARATOR[data]
        full = texts.ends > texts.starts
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[texts.starts[full]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[texts.ends[full] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, texts.starts)
        self.last = np.searchsorted(self.starts, texts.ends)
        self.texts = texts
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            h = np.empty(len(self), U)
            at = 0
            while at < len(self):  # a few slices of bytes at a time, so that a long text takes little more than its own size
                begun = self.starts[at]
                to = max(at + 1, int(np.searchsorted(self.ends, begun + 2 * SLICE_BYTES, side="right")))
                data = self.texts.data[begun : self.ends[to - 1]].astype(U) + U(1)
                h[at:to] = rolling(data, self.starts[at:to] - begun, self.ends[at:to] - begun, _BYTE_BASE)
                at = to
            self._hash = mix(h ^ ((self.ends - self.starts).astype(U) * U(0x2545F4914F6CDD1D)))
        return self._hash

    @property
    def stop(self) -> np.ndarray:
        """For each word, one past the last word of its text."""
        return np.repeat(self.last, self.last - self.first)

    @property
    def begin(self) -> np.ndarray:
        """For each word, the first word of its text."""
        return np.repeat(self.first, self.last - self.first)

    def windows(self, size: int) -> np.ndarray:
        """Where a window of ``size`` words of one text starts."""
        at = np.arange(len(self))
        return at[at + size <= self.stop]

    def window_hash(self, at: np.ndarray, size: int | np.ndarray, second: bool = False) -> np.ndarray:
        return mix(rolling(self.hash, at, at + size, _SECOND_BASE if second else _WORD_BASE))


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, row after the last, texts) with about ``most`` bytes each; a longer text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.array([], column.type)
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)) if len(column) else np.zeros(0, np.int64)
    at = 0
    while at < len(column):
        begun = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, begun + most, side="right")))
        yield at, to, column.slice(at, to - at)
        at = to


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    if not len(ordered) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def covered(at: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges [at, to)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, to, -1)
    return np.cumsum(step[:n]) > 0


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array starts."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)


def run_ends(first: np.ndarray, n: int) -> np.ndarray:
    """Where the runs that start at ``first`` end, in an array of n values."""
    return np.r_[first[1:], n] if len(first) else first


def texts_of(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


class Grams:
    """Byte n-grams of up to eight bytes, packed in integers: ``key`` at every place where one lies within one text."""

    def __init__(self, texts: Texts, n: int):
        data = texts.data
        size = max(0, len(data) - n + 1)
        key = np.zeros(size, U)
        for k in range(n):
            key |= data[k : k + size].astype(U) << U(8 * k)
        begin = np.minimum(texts.starts, size)
        stop = np.minimum(np.maximum(texts.ends - n + 1, texts.starts), size)
        self.count = stop - begin
        if len(begin) and (self.count.sum() < size):
            inside = covered(begin, stop, size)
            key = key[inside]
        self.key = key
        #: Where each text's n-grams begin, and the end of the last.
        self.bounds = np.r_[0, np.cumsum(self.count)]
        self.n = n

    def slot(self, bits: int) -> np.ndarray:
        return ((self.key + U(self.n)) * U(0x9E3779B97F4A7C15) >> U(64 - bits)).astype(np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each text's n-grams."""
        total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, axis=0, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)
