"""A run-length index of many short texts: their Burrows-Wheeler transform in runs, with suffixes sampled at the runs' ends.

Inside a run the suffixes of two neighbouring rows follow equal bytes, so the suffixes that begin one byte earlier are
neighbours too. Which suffix comes before (or after) another in order, and on how many bytes the two agree, is therefore
known wherever a run begins, and from there streams over the texts one byte at a time: the neighbour moves on with the
suffix and the agreement falls by one. The index keeps nothing but the runs and their sampled ends; the order of all suffixes
is only made to find them. Rows that agree on enough bytes are the occurrences of one long string.
"""

from __future__ import annotations

import numpy as np


def _ordered(keys: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their keys, equal ones by place; and dense ranks from 1. wide: bits of a place.

    Key and place are sorted as one number where they fit in one.
    """
    if len(keys) and int(keys.max()).bit_length() + wide <= 63:
        both = np.sort(keys << wide | np.arange(len(keys)))
        order, sorted_keys = both & ((1 << wide) - 1), both >> wide
    else:
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
    fresh = np.ones(len(keys), np.int64)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(fresh)
    return order, out


class RunLengthIndex:
    """Index of texts of any bytes; each ends by itself, and equal suffixes keep the texts' order."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        t = np.frombuffer(b"".join(texts), np.uint8)
        n = self.n = len(t)
        self.ends = np.repeat(self.starts + self.lengths, self.lengths)
        left, wide = self.ends - np.arange(n), max(1, n.bit_length())
        # bytes that occur are numbered from 1, zero is a text's end; the fewer there are, the more go into a word
        there = np.bincount(t, minlength=256) > 0
        self.bits = max(1, int(there.sum()).bit_length())
        self.per = max(1, (63 - wide) // self.bits)
        padded = np.concatenate((np.cumsum(there)[t], np.zeros(self.per, np.int64)))
        self.word = np.zeros(n, np.int64)
        for k in range(self.per):
            self.word <<= self.bits
            self.word |= padded[k : k + n] if k == 0 else np.where(left > k, padded[k : k + n], 0)
        order, rank = _ordered(self.word, wide)
        #: Ranks by the first few bytes, twice as many, and so on, until they reach the longest text's end.
        self.levels = [(self.per, rank)]
        while n and self.levels[-1][0] < self.lengths.max():
            size, rank = self.levels[-1]
            following = np.zeros(n, np.int64)
            following[: max(n - size, 0)] = rank[size:]
            following[left <= size] = 0
            order, rank = _ordered(rank << wide | following, wide)
            self.levels.append((2 * size, rank))
        previous = np.concatenate((np.full(min(n, 1), -1, np.int16), t[:-1].astype(np.int16)))
        previous[self.starts[self.starts < n]] = -1
        before = previous[order]
        #: Runs of the transform: first rows, bytes (-1: a text begins), and the suffixes at both ends.
        self.run_starts = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] < 0)))) if n else np.zeros(0, np.int64)
        self.heads = before[self.run_starts]
        last = np.append(self.run_starts[1:], n) - 1 if n else self.run_starts
        self.samples = np.stack([order[self.run_starts], order[last]], 1) if n else np.zeros((0, 2), np.int64)
        #: On how many bytes a run's first suffix agrees with the last one of the run before.
        self.agree = self._agree(self.samples[1:, 0], self.samples[:-1, 1])
        del self.word, self.levels, self.ends

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes on which suffixes a and b agree; only while the index is made."""
        most = np.minimum(self.ends[a] - a, self.ends[b] - b)
        done, longest = np.zeros(len(a), np.int64), int(most.max(initial=0))
        for size, rank in reversed(self.levels):
            if size <= longest:
                fits = np.flatnonzero(done + size <= most)
                at = done[fits]
                done[fits] += size * (rank[a[fits] + at] == rank[b[fits] + at])
        inside = np.flatnonzero(done < most)
        at = done[inside]
        differ = self.word[a[inside] + at] ^ self.word[b[inside] + at]
        same = np.zeros(len(inside), np.int64)
        for k in range(1, self.per):
            same += (differ >> self.bits * (self.per - k)) == 0
        done[inside] = np.minimum(at + same, most[inside])
        return done

    def _stream(self, at: np.ndarray, neighbour: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in the texts, its suffix's neighbour and their agreement, from those at sampled places; texts' beginnings are sampled."""
        known = np.full(self.n, -1, np.int64)
        known[at] = np.arange(len(at))
        here = np.maximum.accumulate(np.where(known >= 0, np.arange(self.n), 0))
        gone = np.arange(self.n) - here
        return neighbour[known[here]] + gone, np.maximum(agree[known[here]] - gone, 0)

    def predecessors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place, which suffix comes before its own in order, and on how many bytes they agree; agreement 0: perhaps none."""
        return self._stream(self.samples[:, 0], np.append(0, self.samples[:-1, 1]), np.append(0, self.agree))

    def matching_statistics(self) -> np.ndarray:
        """For each place, the longest match of its suffix with any other suffix."""
        if not self.n:
            return np.zeros(0, np.int64)
        before, out = self.predecessors()
        agree = out.copy()
        told = np.flatnonzero(agree)
        np.maximum.at(out, before[told], agree[told])
        return out

    @property
    def suffixes(self) -> np.ndarray:
        """All suffixes in order, step by step from the last one's sample."""
        out = np.zeros(self.n, np.int64)
        if self.n:
            before, _ = self.predecessors()
            out[-1] = self.samples[-1, 1]
            for row in range(self.n - 1, 0, -1):
                out[row - 1] = before[out[row]]
        return out

    def least(self, values: np.ndarray, length: int) -> np.ndarray:
        """For each place, the least value of a text that holds the string of so many bytes that starts there.

        values: one for each text. Places with fewer bytes left give their own text's. Every suffix that agrees with the one
        before it on so many bytes points there; the first of such a chain stands for all of it.
        """
        out = np.repeat(values, self.lengths)
        if not self.n:
            return out
        before, agree = self.predecessors()
        linked = np.flatnonzero(agree >= length)
        first = np.arange(self.n)
        first[linked] = before[linked]
        while len(linked):  # a chain of k is walked in log2(k) rounds
            further = first[first[linked]]
            moved = further != first[linked]
            first[linked] = further
            linked = linked[moved]
        linked = np.flatnonzero(agree >= length)
        np.minimum.at(out, first[linked], out[linked])
        out[linked] = out[first[linked]]
        return out
