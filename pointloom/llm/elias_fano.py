"""Elias-Fano coding of ascending 64-bit values, read in place from a memory map with numpy.

Low bits are packed; high parts are unary in a bit vector of 64-bit words with the count of zeros
before each word, so that the values whose high part is h lie between the h-th and the next zero.
"""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: _SELECT[byte, k]: place of the k-th one of a byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _i in range(256):
    for _k, _b in enumerate(b for b in range(8) if _i >> b & 1):
        _SELECT[_i, _k] = _b


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """values, width bits each, as bytes, little-endian, with 8 bytes to spare."""
    out = np.zeros((len(values) * width + 7) // 8 + 8, np.uint8)
    step = 8 * 4096
    for at in range(0, len(values) if width else 0, step):
        part = np.ascontiguousarray(values[at : at + step], "<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(part, axis=1, bitorder="little")[:, :width]
        packed = np.packbits(bits.ravel(), bitorder="little")
        out[at * width // 8 : at * width // 8 + len(packed)] = packed
    return out


def unpack_at(raw: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The packed values at these indexes; width is 56 at most."""
    if not width:
        return np.zeros(len(at), np.uint64)
    view = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    bit = at * width
    return (view[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of an Elias-Fano sequence of ascending values below universe."""
    n = len(values)
    low = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
    high = (values >> np.uint64(low)).astype(np.int64)
    # bit i + high[i] is a one for every i; the rest, up to one zero for each possible high part, are zeros
    size = n + (universe >> low) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    packed = np.packbits(bits, bitorder="little")
    ones = _ONES[packed].reshape(-1, 8).sum(1).astype(np.int64)
    return {"meta": np.array([n, low], np.int64), "low": pack_bits(values & np.uint64((1 << low) - 1), low), "high": packed, "ones": np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits = map(int, arrays["meta"])
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.zeros = None

    def __len__(self) -> int:
        return self.n

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Bit place of the k-th one (or zero)."""
        if ones:
            before = self.ones
        else:
            if self.zeros is None:
                self.zeros = (np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones).astype(np.int64)
            before = self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        left = k - before[word].astype(np.int64)
        at = word * 64
        done = np.zeros(len(k), bool)
        for byte in range(8):
            b = self.high[word * 8 + byte]
            if not ones:
                b = ~b
            c = _ONES[b].astype(np.int64)
            here = ~done & (left < c)
            at[here] += 8 * byte + _SELECT[b[here], left[here]]
            left = np.where(done | here, left, left - c)
            done |= here
        return at

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at these indexes."""
        i = np.asarray(i, np.int64)
        high = self._select(i, True) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | unpack_at(self.low, i, self.low_bits)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of each value, or -1 where the sequence doesn't have it."""
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        low = x & np.uint64((1 << self.low_bits) - 1)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1 - high, 0)
        end = self._select(high, False) - high
        out = np.full(len(x), -1, np.int64)
        live = np.flatnonzero(begin < end)
        at = begin[live]
        while len(live):
            hit = unpack_at(self.low, at, self.low_bits) == low[live]
            out[live[hit]] = at[hit]
            at += 1
            more = ~hit & (at < end[live])
            live, at = live[more], at[more]
        return out
