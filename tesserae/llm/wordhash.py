"""Vectorised word splitting and hashing over the UTF-8 buffers of Arrow string columns.

Words are maximal runs of bytes other than space and TAB..CR (``[^\\x20\\x09-\\x0D]+``); a document never shares a
word with its neighbour in the buffer. Nothing here loops over words or characters in Python: one call handles a
slice of documents, and callers slice by bytes (``slices``) so that memory follows the slice and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values that spreads every input bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown by doubling."""
    if _POWERS["n"] < n:
        size = max(2 * SLICE_BYTES, 1 << int(n).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("p", _BASE), ("q", inverse)):
            table = np.ones(size, dtype=np.uint64)
            table[1:] = base
            _POWERS[name] = np.multiply.accumulate(table)
        _POWERS["n"] = size
    return _POWERS["p"], _POWERS["q"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; nulls are empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; one longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def parts(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about ``limit`` bytes, so that what is made of a slice stays small."""
    for batch in batches:
        if batch.num_rows:
            for i, j in slices(buffers(batch.column(column))[1], limit):
                yield batch.slice(i, j - i)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker's function that gives memory back to the system when its task ends: workers are used again, and what the
    allocators keep would add up."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


class Words:
    """The words of some texts. ``start`` and ``end`` are byte places in ``data``; ``first[i]:first[i + 1]`` are those of text i.
    ``space`` marks the bytes that are in no word (after ``lower``)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        solid = ~space[self.data]
        n = len(data)
        before = np.zeros(n, dtype=bool)
        before[1:] = solid[:-1]
        heads = offsets[:-1][offsets[:-1] < n]
        before[heads] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = solid[1:]
        tails = offsets[1:] - 1
        after[tails[tails >= 0]] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        p, q = _powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * p[:n], out=total[1:])
        value = (total[self.end] - total[self.start]) * q[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``size`` words in each text, and each text's first place among them (one longer than texts).
        A shorter text, if it has any word, has its whole sequence as its only shingle."""
        word, count = self.hashes(), np.diff(self.first)
        value = window_hash(word, size)
        full = np.maximum(count - size + 1, 0)
        short = (count > 0) & (count < size)
        each = full + short
        first = np.zeros(len(count) + 1, dtype=np.int64)
        np.cumsum(each, out=first[1:])
        out = np.zeros(first[-1], dtype=np.uint64)
        at = np.repeat(self.first[:-1] - first[:-1], each) + np.arange(first[-1])
        usual = np.repeat(~short, each)
        out[usual] = value[at[usual]]
        for i in np.flatnonzero(short):
            whole = word[self.first[i] : self.first[i + 1]]
            out[first[i]] = window_hash(whole, len(whole))[0]
        return out, first


def window_hash(word: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` values; the length takes part, so runs of unlike length differ."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    value = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        value = (value + word[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
    return mix(value)
