"""What chunks of a table send to parts of a hash space, and what parts answer: sorted numbers, and a bit for each.

A key holds its part in the upper 32 bits. Chunks know the order of what they sent, so answers need no keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOW = np.uint64(0xFFFFFFFF)


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts that sorted keys fall into, and where each part's begin and end."""
    ends = np.searchsorted(keys, np.arange(parts, dtype=np.uint64) << np.uint64(32))
    ends = np.append(ends, len(keys))
    return np.flatnonzero(np.diff(ends)), ends


def steps_of(low: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as the steps between them, in as few bytes each as the largest needs."""
    steps = np.diff(low, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def numbers_of(data: bytes) -> np.ndarray:
    wide = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    wide[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    return np.cumsum(wide.view("<u8").ravel())


def flags_of(group: pa.Table, name: str) -> list[np.ndarray]:
    """A chunk's answers by part."""
    told = zip(group.column("part").to_pylist(), group.column(name).to_pylist(), group.column("n").to_pylist())
    return [np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) for _, bits, n in sorted(told)]


def answer(group: pa.Table, flags: list[np.ndarray]) -> pa.Table:
    return pa.table({"chunk": group.column("chunk"), "part": group.column("part"), "bits": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()), "n": pa.array([len(f) for f in flags], pa.int32())})


ANSWERS = "chunk int, part int, bits binary, n int"
