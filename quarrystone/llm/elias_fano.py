"""Elias-Fano coding of a non-decreasing sequence, with a sampled select structure.

n values below u take about n * (2 + log2(u / n)) bits: the low bits of each stand in a packed
array, the high bits in a unary bit vector where value i is the i-th one. select() finds that one
from the nearest sample (one in 256), so single values are read without decoding the rest.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBxxxxxxxQQQ")


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def _unpack(data: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def encode(values: np.ndarray, universe: int) -> bytes:
    """values: non-decreasing, from 0 to universe."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((universe >> low) + n + 1 if n else 0, np.uint8)
    high[ones] = 1
    lows = _pack(v & np.uint64((1 << low) - 1), low)
    highs = np.packbits(high, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4").tobytes() if not n or ones[-1] < 1 << 32 else None
    if samples is None:
        raise ValueError("a shard's sequence is limited to 2**32 bits")
    return _HEAD.pack(n, universe, low, len(lows), len(highs), len(samples)) + lows + highs + samples


class Sequence:
    """Reads what encode() wrote, from a buffer at a place."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.universe, self.low, a, b, c = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        view = np.frombuffer(data, np.uint8)
        self.lows, self.highs = view[at : at + a], view[at + a : at + a + b]
        self.samples = np.frombuffer(data, "<u4", c // 4, at + a + b)
        self.end = at + a + b + c

    def select(self, i: int) -> int:
        """Value i alone."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        window = np.unpackbits(self.highs[byte : byte + 64], bitorder="little")[place & 7 :]
        while True:
            ones = np.flatnonzero(window)
            if left < len(ones):
                break
            left -= len(ones)
            place += len(window)
            byte = place >> 3
            window = np.unpackbits(self.highs[byte : byte + 256], bitorder="little")
        one = place + int(ones[left])
        low = 0
        for k in range(self.low):
            bit = i * self.low + k
            low |= (int(self.lows[bit >> 3]) >> (bit & 7) & 1) << k
        return (one - i) << self.low | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        return (high | _unpack(self.lows, self.low, self.n)).astype(np.int64)
