"""A small logistic regression over sparse binary features, for bounded training sets."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, y: np.ndarray, n_columns: int, penalty: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the sparse columns, of the dense columns, and the bias.

    ``rows`` and ``columns`` are the places of the ones.  Gradient descent with
    momentum and a step per column that follows how often the column is set.
    A target without both classes gives weights of zero.
    """
    n = len(y)
    rate = (y.sum() + 0.5) / (n + 1)
    w, v, b = np.zeros(n_columns), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate)))
    if not 0 < y.sum() < n:
        return w, v, b
    often = np.bincount(columns, minlength=n_columns) / n
    step_w, step_v = 1 / (penalty + 0.5 * np.sqrt(often) + 1e-9), 1 / (penalty + 2 * (dense**2).mean(0) + 1e-9)
    mw, mv, mb = np.zeros_like(w), np.zeros_like(v), 0.0
    for _ in range(steps):
        z = np.bincount(rows, w[columns], minlength=n) + dense @ v + b
        e = (sigmoid(z) - y) / n
        mw = 0.9 * mw - 0.2 * step_w * (np.bincount(columns, e[rows], minlength=n_columns) + penalty * w * often)
        mv = 0.9 * mv - 0.2 * step_v * (e @ dense + penalty * v)
        mb = 0.9 * mb - 0.4 * e.sum()
        w, v, b = w + mw, v + mv, b + mb
    return w, v, b


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold on p with the highest F1, in the middle of its gap; 0.5 where the target has one class."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(np.argmax(f1))
    below = p[order[at + 1]] if at + 1 < len(y) else 0.0
    return float((p[order[at]] + below) / 2)
