"""Whole texts as numpy arrays, for use inside ``mapInArrow`` tasks.

A slice of an Arrow batch is seen as one byte array plus document offsets; words, lines and
their hashes come from array operations over all documents of the slice at once. Slices are
cut by bytes, so memory follows ``max_bytes`` and the longest single text, not the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
# Documents of a slice fit the 12 bits above the 52 hash bits of a document-wise key.
SLICE_DOCS = 4096
HASH_BITS = 52

_U = np.uint64
_rng = np.random.default_rng(0x5F7)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=_U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_CODE = _BYTE_CODE[_LOWER]
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Bytes that start a code point (everything but UTF-8 continuation bytes).
_LEAD = (np.arange(256) & 0xC0) != 0x80
_powers: list[np.ndarray] = []


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            made = []
            for base in (_BASE, _INVERSE):
                p = np.full(size, base, _U)
                p[0] = 1
                made.append(np.cumprod(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def hash_segments(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False
) -> np.ndarray:
    """64-bit hashes of the byte ranges, ranges being in ascending order and disjoint.

    A prefix sum of coded bytes times powers gives every range by one difference; ranges
    are handled in chunks of bounded length, however long a text is.
    """
    out = np.empty(len(starts), _U)
    code = _LOWER_CODE if lower else _BYTE_CODE
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + (1 << 20), "right")))
        high = ends[last - 1]
        power, inverse = _power_tables(int(high - low) + 1)
        sums = np.zeros(high - low + 1, _U)
        np.cumsum(code[data[low:high]] * power[: high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)
        first = last
    return mix(out)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` consecutive items, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, _U)
    total = np.zeros(n, _U)
    factor = _U(1)
    with np.errstate(over="ignore"):
        for i in range(width):
            factor = _U(factor * _BASE)
            total += hashes[i : i + n] * factor
    return mix(total)


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each range of ``offsets``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_keys(keys: np.ndarray) -> np.ndarray:
    """The sorted distinct values that occur more than once."""
    s = np.sort(keys)
    same = s[1:] == s[:-1]
    return np.unique(s[1:][same])


def members(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted ``table``."""
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys


@dataclass
class Texts:
    """The texts of a batch slice: document ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> str:
        return bytes(self.data[self.offsets[i] : self.offsets[i + 1]]).decode()

    def take(self, rows: np.ndarray) -> Texts:
        """The chosen documents as texts of their own."""
        if len(rows) == self.size:
            return self
        starts = self.offsets[rows]
        lengths = self.offsets[rows + 1] - starts
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        index = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
        return Texts(self.data[index], offsets)

    def _ranges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of set bytes that do not cross documents: starts, ends, documents."""
        filled = self.offsets[:-1][self.offsets[1:] > self.offsets[:-1]]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[filled] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[filled[1:] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def runs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._ranges(table[self.data])

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the runs of other bytes than space and 0x09-0x0D."""
        return self._ranges(~_SPACE[self.data])

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.words[2], minlength=self.size).astype(np.int64)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return hash_segments(self.data, self.words[0], self.words[1])

    @cached_property
    def lower_word_hashes(self) -> np.ndarray:
        return hash_segments(self.data, self.words[0], self.words[1], lower=True)

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points in words."""
        return counts_between(_LEAD[self.data] & ~_SPACE[self.data], self.offsets)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the ``\\n``-split lines that hold a word."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.unique(np.concatenate([self.offsets[:-1], breaks + 1]))
        starts = starts[starts < len(self.data)]
        docs = np.searchsorted(self.offsets, starts, "right") - 1
        stops = np.append(breaks, len(self.data))
        ends = np.minimum(stops[np.searchsorted(breaks, starts)], self.offsets[docs + 1])
        words = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(~_SPACE[self.data], out=words[1:])
        keep = words[ends] > words[starts]
        return starts[keep], ends[keep], docs[keep]

    def count_bytes(self, table: np.ndarray) -> np.ndarray:
        return counts_between(table[self.data], self.offsets)

    def code_points(self) -> np.ndarray:
        """Prefix counts of code points by byte position, from the slice's start."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(_LEAD[self.data], out=sums[1:])
        return sums


def doc_keys(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sortable keys that are equal for equal hashes of one document only."""
    return (docs.astype(_U) << _U(HASH_BITS)) | (hashes >> _U(64 - HASH_BITS))


def texts_of(column: pa.Array) -> Texts:
    """A string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(ends):
        return Texts(np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    return Texts(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0])


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut batches into runs of rows with about ``max_bytes`` of text, one row at least."""
    for batch in batches:
        whole = texts_of(batch.column(column))
        first = 0
        while first < batch.num_rows:
            limit = whole.offsets[first] + max_bytes
            last = int(np.searchsorted(whole.offsets, limit, "right")) - 1
            last = min(max(last, first + 1), first + SLICE_DOCS, batch.num_rows)
            low, high = whole.offsets[first], whole.offsets[last]
            yield (
                batch.slice(first, last - first),
                Texts(whole.data[low:high], whole.offsets[first : last + 1] - low),
            )
            first = last


class HashIndex:
    """An open-addressing map from 64-bit keys to row numbers, filled and read in bulk."""

    def __init__(self, bits: int = 12):
        self._reset(bits)

    def _reset(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, _U)
        self.rows = np.zeros(1 << bits, np.int32)
        self.size = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is missing."""
        keys = np.maximum(keys, _U(1))  # zero marks an empty slot
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.rows[slots], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != 0))
        slots = slots[left]
        while len(left):
            slots = (slots + 1) & (len(self.keys) - 1)
            held, wanted = self.keys[slots], keys[left]
            hit = held == wanted
            out[left[hit]] = self.rows[slots[hit]]
            on = ~hit & (held != 0)
            left, slots = left[on], slots[on]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Enter distinct keys that are not yet there."""
        keys = np.maximum(keys, _U(1))
        if 2 * (self.size + len(keys)) > len(self.keys):
            filled = self.keys != 0
            old = self.keys[filled], self.rows[filled]
            self._reset(int(4 * (self.size + len(keys))).bit_length())
            self._enter(*old)
        self._enter(keys, rows)

    def _enter(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.size += len(keys)
        slots = self._slots(keys)
        rows = rows.astype(np.int32)
        while len(keys):
            free = self.keys[slots] == 0
            self.keys[slots[free]] = keys[free]
            mine = free & (self.keys[slots] == keys)
            self.rows[slots[mine]] = rows[mine]
            keys, rows, slots = keys[~mine], rows[~mine], (slots[~mine] + 1) & (len(self.keys) - 1)
