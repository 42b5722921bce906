"""Golomb-Rice coding of sorted whole numbers, in numpy."""

from __future__ import annotations

import math

import numpy as np


def encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted non-negative int64 values -> (k, code): the gaps' quotients by 2**k in unary, then their k-bit remainders."""
    gaps = np.diff(values, prepend=0)
    n = len(gaps)
    if not n:
        return 0, b""
    k = max(0, int(math.log2(max(1.0, float(values[-1]) / n * math.log(2)))))
    q = gaps >> k
    unary = np.ones(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def decode(n: int, k: int, code: bytes) -> np.ndarray:
    """The n values that ``encode`` took."""
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(code, np.uint8)
    tail = -(-n * k // 8)
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]) == 0)[:n]
    q = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(raw[len(raw) - tail :])[: n * k].reshape(n, k).astype(np.int64)
    r = rest @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else 0
    return np.cumsum((q.astype(np.int64) << k) + r)
