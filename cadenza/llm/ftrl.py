"""Follow-the-regularised-leader (proximal) with elastic-net penalties, for sparse rows."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights (outputs, features), each with its own learning rate.

    A weight stays exactly 0 while its gradients add up to less than ``l1``.
    """

    def __init__(self, outputs: int, features: int, alpha: float, l1: float, l2: float, beta: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((outputs, features))
        self.n = np.zeros((outputs, features))

    def weights(self, columns: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[:, columns], self.n[:, columns]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, columns: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[:, columns]
        grown = n + gradient * gradient
        self.z[:, columns] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * weights
        self.n[:, columns] = grown


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_multinomial(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, features: int, alpha: float, l1: float, l2: float, epochs: int, seed: int = 0) -> np.ndarray:
    """Weights (classes, features) of a multinomial logistic regression; rows are (columns, values)."""
    model, rng = Ftrl(classes, features, alpha, l1, l2), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            columns, values = rows[i]
            w = model.weights(columns)
            error = softmax(w @ values)
            error[labels[i]] -= 1
            model.update(columns, w, error[:, None] * values)
    return model.weights()


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that makes labels likeliest, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, features: int, alpha: float, l1: float, l2: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-link regression: P(grade <= j) = logistic(threshold_j - score).

    The weights are shared by all levels. Returns them and the ordered thresholds.
    """
    model, rng = Ftrl(1, features, alpha, l1, l2), np.random.default_rng(seed)
    share = np.cumsum(np.bincount(grades, minlength=levels) + 1.0) / (len(grades) + levels)
    cut = np.log(share[:-1] / (1 - share[:-1]))
    seen = np.ones(levels - 1)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            columns, values = rows[i]
            w = model.weights(columns)
            score, y = float(w[0] @ values), grades[i]
            upper = logistic(cut[y] - score) if y < levels - 1 else 1.0
            lower = logistic(cut[y - 1] - score) if y else 0.0
            model.update(columns, w, (1 - upper - lower) * values[None])
            p = max(upper - lower, 1e-9)
            for j, g in ((y, -upper * (1 - upper) / p), (y - 1, lower * (1 - lower) / p)):
                if 0 <= j < levels - 1 and g:
                    g = max(-1.0, min(1.0, g))
                    seen[j] += g * g
                    cut[j] -= g / np.sqrt(seen[j])
            cut = np.maximum.accumulate(cut + 1e-3 * np.arange(levels - 1)) if (np.diff(cut) < 1e-3).any() else cut
    return model.weights()[0], cut
