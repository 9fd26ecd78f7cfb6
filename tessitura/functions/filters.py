"""Recursive filters over the rows of a matrix, by blocks of matrix products."""

from __future__ import annotations

import numpy as np


def one_pole(x: np.ndarray, pole: float, block: int = 256) -> np.ndarray:
    """y[t] = x[t] + pole * y[t-1] along the first axis, y before the start being 0."""
    x = np.asarray(x, dtype=np.float64)
    t = np.arange(block)
    powers = np.where(t[:, None] >= t, pole ** np.maximum(t[:, None] - t, 0), 0.0)
    fade, y, last = pole ** (t + 1.0), np.empty_like(x), np.zeros(x.shape[1:])
    for i in range(0, len(x), block):
        part = x[i : i + block]
        n = len(part)
        y[i : i + n] = powers[:n, :n] @ part + np.multiply.outer(fade[:n], last)
        last = y[i + n - 1]
    return y
