"""Words of whole texts as numpy arrays, straight from Arrow's UTF-8 buffers.

A word is a run of bytes other than space and 0x09-0x0D.  UTF-8 never uses
those bytes inside a longer character, so words of bytes are words of text.
A word's 64-bit hash is a polynomial over random byte values; prefix sums give
all hashes of a piece in a few array passes, without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xD1342543DE82EF95 | 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: For matching across punctuation: every ASCII byte that is no letter or digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_VALUES = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE))
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]

_OTHER_BASE = 0xC2B2AE3D27D4EB4F | 1
_OTHER_VALUES = mix64(np.arange(1, 257, dtype=_U) * _U(0x165667B19E3779F9))
_OTHER_LOWER_VALUES = _OTHER_VALUES.copy()
_OTHER_LOWER_VALUES[ord("A") : ord("Z") + 1] = _OTHER_VALUES[ord("a") : ord("z") + 1]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n; kept for the next piece."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            step = np.full(size, b, _U)
            step[0] = 1
            both.append(np.multiply.accumulate(step))
        got = (both[0], both[1])
        if size <= 4 * PIECE_BYTES:
            _powers[base] = got
    return got


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``size`` bytes of text each (one row at
    least), with the bytes and offsets of ``column``: they bound the arrays that
    a task holds, whatever the batch size."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        if not batch.num_rows:
            continue
        data, offs = utf8_buffers(batch.column(at))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


class Words:
    """start, end: byte positions; of: word offsets by document (one more than
    documents); doc: each word's document; hash: 64 bits by word."""

    __slots__ = ("data", "offs", "start", "end", "of", "doc", "hash")

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, hashed: bool = True, separator: np.ndarray = SEPARATOR):
        n = len(data)
        self.data, self.offs = data, offs
        word = ~separator[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        first = word & (~before | edge[:-1])
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        last = word & (~after | edge[1:])
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.of))
        if hashed:
            self.hash = self._hashes(_BASE, _LOWER_VALUES if lower else _VALUES)

    def _hashes(self, base: int, values: np.ndarray) -> np.ndarray:
        n = len(self.data)
        powers, inverse = _power_tables(base, n)
        sums = np.zeros(n + 1, _U)
        terms = values[self.data]
        terms *= powers[:n]
        np.cumsum(terms, out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * inverse[self.start])

    def second_hash(self, lower: bool = False) -> np.ndarray:
        """Another hash by word, independent of the first."""
        return self._hashes(_OTHER_BASE, _OTHER_LOWER_VALUES if lower else _OTHER_VALUES)

    def windows(self, n: int, by_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words of one document, from the
        words' own hashes or those given."""
        total = len(self.start)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        at = np.arange(total - n + 1)
        at = at[self.doc[: total - n + 1] == self.doc[n - 1 :]]
        powers, inverse = _power_tables(_WINDOW_BASE, total)
        sums = np.zeros(total + 1, _U)
        np.cumsum((self.hash if by_word is None else by_word) * powers[:total], out=sums[1:])
        return at, mix64((sums[at + n] - sums[at]) * inverse[at] + _U(n))


def exact_ids(w: Words) -> np.ndarray:
    """A number for each word, the same where their bytes are: words with equal
    hashes are compared."""
    _, first, ids = np.unique(w.hash, return_index=True, return_inverse=True)
    lead = first[ids]
    other = np.flatnonzero(lead != np.arange(len(lead)))
    length = w.end - w.start
    same = bool((length[other] == length[lead[other]]).all())
    lo = 0
    ends = np.cumsum(length[other])
    while same and lo < len(other):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE_BYTES, "right")))
        own, n = other[lo:hi], length[other[lo:hi]]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = bool((w.data[np.repeat(w.start[own], n) + step] == w.data[np.repeat(w.start[lead[own]], n) + step]).all())
        lo = hi
    if same:
        return ids
    raw, numbers = w.data.tobytes(), {}
    return np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)])
