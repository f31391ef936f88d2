"""Linear models on hashed features, fitted on a bounded sample: multinomial logistic regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(
    rows: Sequence[tuple[np.ndarray, np.ndarray | None]], targets: np.ndarray, size: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, seed: int = 0
) -> np.ndarray:
    """Weights (size, classes) by follow-the-regularised-leader with elastic-net penalties.

    rows: (feature indices, values or None for ones), each index once a row. targets: class probabilities (rows, classes).
    """
    z = np.zeros((size, targets.shape[1]))
    n = np.zeros_like(z)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        kept = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -kept / ((beta + np.sqrt(n)) / alpha + l2)

    turn = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in turn.permutation(len(rows)):
            at, x = rows[k]
            if not len(at):
                continue
            w = weights(z[at], n[at])
            g = x[:, None] * (softmax(x @ w) - targets[k]) if x is not None else np.repeat([softmax(w.sum(0)) - targets[k]], len(at), 0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    # By blocks and in place, so that no further array of this size is made.
    for at in range(0, size, 1 << 16):
        z[at : at + (1 << 16)] = weights(z[at : at + (1 << 16)], n[at : at + (1 << 16)])
    return z


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log-loss on rows that weren't fitted; 1 without rows."""
    if not len(logits):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


#: Values of sample_key(): a row is in a sample if its own is below the wanted share.
KEYS = 1 << 30


def sample_key(*columns: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), *columns), F.lit(KEYS))


def bounded_sample(df: DataFrame, rows: int, n_rows: int, *columns: str) -> DataFrame:
    """About ``rows`` of the ``n_rows`` rows of ``df``, the same ones each time, and never more."""
    share = min(1.0, 0.9 * rows / max(1, n_rows))
    return df.where(sample_key(*columns) < int(share * KEYS) + (share == 1.0)).limit(rows)
