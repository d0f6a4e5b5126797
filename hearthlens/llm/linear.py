"""Sparse linear models trained with follow-the-regularised-leader and elastic-net penalties."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: the columns and values of each row, one after the other."""

    def __init__(self, lengths: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.columns = columns
        self.values = values

    def __len__(self) -> int:
        return len(self.ends)

    def take(self, rows: np.ndarray) -> "Rows":
        lengths = self.ends[rows] - self.starts[rows]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - lengths), lengths)
        return Rows(lengths, self.columns[at], self.values[at])

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Products with a matrix of (column, class) weights."""
        products = weights[self.columns] * self.values[:, None]
        sums = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(products, axis=0)])
        return sums[self.ends] - sums[self.starts]


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def train_ftrl(rows: Rows, labels: np.ndarray, columns: int, classes: int, epochs: int = 4, batch: int = 32,
               alpha: float = 0.2, beta: float = 1.0, l1: float | np.ndarray = 0.5, l2: float = 0.5, seed: int = 1,
               class_weights: np.ndarray | None = None) -> np.ndarray:
    """Weights (column, class) of a multinomial logistic regression by the proximal form of
    follow-the-regularised-leader: per-coordinate learning rates from the sum of squared gradients, the
    l1 penalty leaving most weights at exactly zero, the l2 penalty shrinking the others. Column 0 is
    the intercept and free of penalties; ``l1`` may differ by column; every row is expected to have it. Rows are visited in seeded
    random order, a few at a time."""
    z = np.zeros((columns, classes))
    n = np.zeros((columns, classes))
    first, second = np.full((columns, 1), 0.0), np.full((columns, 1), l2)
    first[:, 0] = l1
    first[0] = second[0] = 0.0
    targets = np.eye(classes)[labels]
    random = np.random.default_rng(seed)

    def current(at: np.ndarray) -> np.ndarray:
        held = z[at]
        rate = (beta + np.sqrt(n[at])) / alpha + second[at]
        return np.where(np.abs(held) <= first[at], 0.0, -(held - np.sign(held) * first[at]) / rate)

    for _ in range(epochs):
        order = random.permutation(len(rows))
        for start in range(0, len(order), batch):
            chosen = order[start:start + batch]
            part = rows.take(chosen)
            touched, at = np.unique(part.columns, return_inverse=True)
            weights = current(touched)
            error = softmax(Rows(part.ends - part.starts, at, part.values).times(weights)) - targets[chosen]
            if class_weights is not None:
                error *= class_weights[labels[chosen]][:, None]
            pushed = np.repeat(error, part.ends - part.starts, axis=0) * part.values[:, None]
            gradient = np.stack([np.bincount(at, pushed[:, k], len(touched)) for k in range(classes)], axis=1)
            held = n[touched]
            grown = held + gradient * gradient
            z[touched] += gradient - (np.sqrt(grown) - np.sqrt(held)) / alpha * weights
            n[touched] = grown
    return current(np.arange(columns))
