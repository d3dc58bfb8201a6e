"""Elias-Fano codes for non-decreasing integers: low bits packed, high bits in unary, and a packed directory for select.

n numbers below u take about n (2 + log2(u / n)) bits, and the i-th comes back without reading the others: the directory,
stored with the code, says where every SAMPLE-th one of the high bits stands, in as few bits as the place of the last one
needs; from there on ones are counted word by word. Nothing but the code's own bytes is kept in memory.
"""

from __future__ import annotations

import struct

import numpy as np

#: Magic, bits of a low part, bits of a directory entry, numbers, and bytes of lows, highs and directory.
HEAD = struct.Struct("<4sBBQQQQ")
MAGIC = b"EFB2"
#: Every so many ones of the high bits, their place is noted.
SAMPLE = 256


def _packed(values: np.ndarray, width: int) -> bytes:
    """Numbers of so many bits each, one after the other."""
    bits = ((values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def _at(data: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    """The i-th of packed numbers."""
    place = i[:, None] * width + np.arange(width)
    bit = (data[place >> 3] >> (place & 7).astype(np.uint8)) & 1
    return (bit.astype(np.int64) << np.arange(width)).sum(1)


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing array of non-negative integers."""
    v = np.asarray(values, np.uint64)
    if len(v) and (v[1:] < v[:-1]).any():
        raise ValueError("values must not decrease")
    n, top = len(v), int(v[-1]) + 1 if len(v) else 1
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    wide = int(ones[-1]).bit_length() if n else 0
    lows, highs, directory = _packed(v, low), np.packbits(high, bitorder="little").tobytes(), _packed(ones[::SAMPLE], wide)
    return HEAD.pack(MAGIC, low, wide, n, len(lows), len(highs), len(directory)) + lows + highs + directory


class EliasFano:
    """Reads what ``encode`` made; ``select(i)`` is the i-th number, ``selects`` several, ``all()`` all of them."""

    def __init__(self, data: bytes | memoryview):
        magic, self.low, self.wide, self.n, lows, highs, directory = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not an Elias-Fano block")
        self.lows = np.frombuffer(data, np.uint8, lows, HEAD.size)
        self.highs = np.frombuffer(data, np.uint8, highs, HEAD.size + lows)
        self.directory = np.frombuffer(data, np.uint8, directory, HEAD.size + lows + highs)
        self.size = HEAD.size + lows + highs + directory

    def _words(self, at: np.ndarray) -> np.ndarray:
        """64 of the high bits each, from these bytes on; zeros after the end."""
        place = at[:, None] + np.arange(8)
        told = np.where(place < len(self.highs), self.highs[np.minimum(place, len(self.highs) - 1)], np.uint8(0))
        return np.ascontiguousarray(told).view("<u8")[:, 0]

    def selects(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        i = np.asarray(i, np.int64)
        if len(i) and not 0 <= int(i.min()) <= int(i.max()) < self.n:
            raise IndexError(i)
        begin = _at(self.directory, self.wide, i // SAMPLE)
        left, byte = i % SAMPLE, begin >> 3
        word = self._words(byte) >> (begin & 7).astype(np.uint64) << (begin & 7).astype(np.uint64)
        ones = np.bitwise_count(word).astype(np.int64)
        far = np.flatnonzero(left >= ones)
        while len(far):
            left[far] -= ones[far]
            byte[far] += 8
            word[far] = self._words(byte[far])
            ones[far] = np.bitwise_count(word[far])
            far = far[left[far] >= ones[far]]
        far = np.flatnonzero(left)
        while len(far):  # the lowest ones go until the wanted one is the lowest
            word[far] &= word[far] - np.uint64(1)
            left[far] -= 1
            far = far[left[far] > 0]
        place = 8 * byte + np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        return ((place - i) << self.low) | _at(self.lows, self.low, i)

    def select(self, i: int) -> int:
        return int(self.selects(np.array([i]))[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.low) | _at(self.lows, self.low, np.arange(self.n))
