"""A hashed linear scorer, fitted on the driver over a bounded sample."""

from __future__ import annotations

import zlib

import numpy as np

SLOTS = 1 << 18


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 8, rate: float = 0.5, l1: float = 0.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Adagrad over (slots, values, target in 0..1); a fixed order, so equal rows give equal weights. ``l1`` pulls weights to zero, which few rows with many rare features need."""
    w, g2 = np.zeros(SLOTS, np.float64), np.full(SLOTS, 1e-2)
    mean = (sum(t for _, _, t in rows) + 0.5) / (len(rows) + 1)
    b, gb, rng = float(np.log(mean / (1 - mean))), 1.0, np.random.default_rng(0)
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for j in order:
            at, v, t = rows[j]
            s = b + float(w[at] @ v)
            g = 1 / (1 + np.exp(-max(-30.0, min(30.0, s)))) - t
            step = g * v
            g2[at] += step * step
            pace = rate / np.sqrt(g2[at])
            new = w[at] - pace * step
            w[at] = np.sign(new) * np.maximum(0.0, np.abs(new) - l1 * pace) if l1 else new
            gb += g * g
            b -= rate * g / np.sqrt(gb)
    return w.astype(np.float32), float(b)


def sigmoid(s: float) -> float:
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, s)))))
