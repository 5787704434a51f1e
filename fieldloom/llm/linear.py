"""Logistic regression in numpy, for the bounded training samples that the classifiers take."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Sparse rows: the columns of each row and their values."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray] | None, width: int):
        sizes = np.array([len(c) for c in columns], np.int64)
        self.n, self.width = len(columns), width
        self.row = np.repeat(np.arange(self.n), sizes)
        self.column = np.concatenate(columns).astype(np.int64) if len(columns) else np.empty(0, np.int64)
        self.value = np.concatenate(values).astype(float) if values is not None and len(values) else np.ones(len(self.column))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], self.width)


def fit(x: Rows, y: np.ndarray, l2: float, weight: np.ndarray | None = None, pairs: Rows | None = None, pair_penalty: float = 0.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias for targets ``y`` in [0, 1].

    ``pairs`` has a row of feature differences for each counterfactual pair: the squared change of the logit is
    penalised. Full-batch Adam with a falling step: deterministic.
    """
    w, b = np.zeros(x.width), 0.0
    weight = np.ones(len(y)) if weight is None else weight
    total = max(weight.sum(), 1e-9)
    prior = np.clip((weight * y).sum() / total, 1e-3, 1 - 1e-3) if len(y) else 0.5
    b = float(np.log(prior / (1 - prior)))
    m, v = np.zeros(x.width + 1), np.zeros(x.width + 1)
    for t in range(1, steps + 1 if len(y) else 1):
        r = weight * (sigmoid(x.dot(w) + b) - y)
        g = np.append(x.transposed(r) / total + l2 * w, r.sum() / total)
        if pairs is not None and pairs.n:
            g[:-1] += 2 * pair_penalty / pairs.n * pairs.transposed(pairs.dot(w))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.2 / (1 + t / 100) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b
