"""Words and word hashes of Arrow text columns, computed on the UTF-8 bytes with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z is folded to a-z. Hashes are
64 bits, fixed across processes: equal words have equal hashes, and unequal words differ but for
a chance of about 2**-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[_SPACE] = 0
_EXACT, _VALUE = _VALUE, _VALUE[_FOLD]
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, BLOCK)
        have = np.ones(size, np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if size <= 4 * BLOCK:
            _powers[int(base)] = have
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins and the last ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `most` bytes, one row at least."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each word, byte after each word, and the words before each row (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    row_starts = offsets[:-1][offsets[:-1] < n]
    begins[row_starts] = word[row_starts]
    starts = np.flatnonzero(begins)
    ends_here = word.copy()
    ends_here[:-1] &= ~word[1:]
    row_ends = offsets[1:][offsets[1:] > 0] - 1
    ends_here[row_ends] = word[row_ends]
    ends = np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """The hash of data[starts[i]:ends[i]] for every i, A-Z folded or not; spans ascend and don't overlap."""
    out, value = np.empty(len(starts), np.uint64), _VALUE if fold else _EXACT
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        size = int(ends[to - 1] - base)
        terms = value[data[base : base + size]]
        terms *= _power(_R, size)
        local = starts[at:to] - base
        out[at:to] = np.add.reduceat(terms, local) * _power(_R_INVERSE, size)[local]
        at = to
    return mix(out)


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and the number of words before each row."""
    data, offsets = utf8(column)
    starts, ends, rows = spans(data, offsets)
    return hash_spans(data, starts, ends), rows
