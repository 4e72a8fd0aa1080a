"""Sparse linear models, fitted by the follow-the-regularised-leader update.

Examples are (feature numbers, values) pairs. A fit runs on a bounded sample of
labelled rows; scoring runs inside Spark tasks with the weights alone.
"""

from __future__ import annotations

import numpy as np

Example = tuple[np.ndarray, np.ndarray]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Ftrl:
    """FTRL-proximal with per-coordinate rates and elastic net; one weight column per class.

    The last row of the tables is the intercept, which carries no penalty.
    """

    def __init__(self, features: int, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.z = np.zeros((features + 1, classes))
        self.n = np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, rows: np.ndarray) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        rate = (self.beta + np.sqrt(n)) / self.alpha
        inner = (rows < len(self.z) - 1)[:, None]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(inner, self.l1, 0.0), 0.0)
        return -shrunk / (rate + np.where(inner, self.l2, 0.0))

    def fit(self, examples: list[Example], targets: np.ndarray, epochs: int, seed: int = 7) -> Ftrl:
        """``targets``: one row of class probabilities per example (a single column: a logistic model)."""
        order, last = np.random.default_rng(seed), len(self.z) - 1
        single = targets.shape[1] == 1
        for _ in range(epochs):
            for i in order.permutation(len(examples)):
                rows = np.append(examples[i][0], last)
                x = np.append(examples[i][1], 1.0)
                w = self._weights(rows)
                logits = x @ w
                gap = (sigmoid(logits) if single else softmax(logits)) - targets[i]
                g = x[:, None] * gap
                squared = self.n[rows] + g * g
                self.z[rows] += g - (np.sqrt(squared) - np.sqrt(self.n[rows])) / self.alpha * w
                self.n[rows] = squared
        return self

    def weights(self) -> np.ndarray:
        """(features + 1, classes), intercepts last; zero where the penalty holds."""
        return self._weights(np.arange(len(self.z)))


def logits(examples: list[Example], weights: np.ndarray) -> np.ndarray:
    if not examples:
        return np.zeros((0, weights.shape[1]))
    return np.array([x @ weights[f] + weights[-1] for f, x in examples])


def temperature(z: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits under which held-back classes are likeliest (golden-section search).

    One row in ``len(z) + 2`` counts as mislabelled, so that faultless rows don't make it vanish.
    """
    if not len(z):
        return 1.0
    wrong = 1.0 / (len(z) + 2.0)

    def loss(log_t: float) -> float:
        p = np.log(np.maximum(softmax(z / np.exp(log_t)), 1e-300))
        right = p[np.arange(len(z)), truth]
        other = (p.sum(axis=1) - right) / max(1, p.shape[1] - 1)
        return -float(((1.0 - wrong) * right + wrong * other).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
