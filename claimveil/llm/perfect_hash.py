"""A minimal perfect hash of distinct strings: each has a slot of its own, 0 to n-1, and stored keys tell strangers apart."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Bits for each key that is still without a place, on each level.
WIDE = 2


def digests(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte string."""
    return tuple(pd.util.hash_array(keys, hash_key=k, categorize=False) for k in ("first half of it", "second half here"))


def strings(keys: list[bytes]) -> np.ndarray:
    out = np.empty(len(keys), object)
    out[:] = keys
    return out


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    h = (a ^ np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33)) ^ b) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


class PerfectHash:
    """On each level keys that meet no other take a bit, the rest go on to the next; a slot is the number of bits set before.

    ``keys`` are the stored keys by slot. Two different keys with the same 128 bits of hashes raise an error.
    """

    def __init__(self, keys: list[bytes]):
        given = strings(keys)
        a, b = digests(given)
        self.sizes, bits, rest = [], [np.zeros(0, bool)], np.arange(len(a))
        while len(rest):
            if len(self.sizes) > 200:
                raise ValueError("keys must be distinct")
            size = max(64, WIDE * len(rest))
            at = (_mix(a[rest], b[rest], len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
        self.bits = np.concatenate(bits)
        self.rank = np.concatenate(([0], np.cumsum(self.bits)))
        self.keys = np.empty(len(given), object)
        self.keys[self._places(a, b)] = given

    def _places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, rest, base = np.full(len(a), -1), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mix(a[rest], b[rest], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[rest[hit]] = self.rank[at[hit]]
            rest, base = rest[~hit], base + size
        return out

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """Slots of keys; -1 for one that isn't stored."""
        if not len(self.keys) or not len(keys):
            return np.full(len(keys), -1)
        given = strings(keys)
        found = self._places(*digests(given))
        return np.where((found >= 0) & (self.keys[found] == given), found, -1)
