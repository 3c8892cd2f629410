"""Hashed text features shared by the trained classifiers, and follow-the-regularised-leader training."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """FTRL-proximal logistic regression with elastic-net penalties, multinomial over sparse examples.

    fit() takes examples as (indices, values) with a class each; weights that the L1 penalty holds at zero stay zero.
    """

    def __init__(self, dims: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.bias = np.zeros(classes)
        self.bias_n = np.zeros(classes)

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, seed: int = 7) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(examples)):
                at, x = examples[k]
                w = self.weights(at)
                score = x @ w + self.bias
                score = np.exp(score - score.max())
                g = score / score.sum()
                g[labels[k]] -= 1.0
                self.bias_n += g * g
                self.bias -= self.alpha * g / (self.beta + np.sqrt(self.bias_n))
                grad = np.outer(x, g)
                n = self.n[at]
                step = (np.sqrt(n + grad * grad) - np.sqrt(n)) / self.alpha
                self.z[at] += grad - step * w
                self.n[at] = n + grad * grad
        return self


def softmax(scores: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    e = np.exp((scores - scores.max(axis=1, keepdims=True)) / temperature)
    return e / e.sum(axis=1, keepdims=True)


def temperature_of(scores: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of the least log loss on held-back examples, by golden-section search in its logarithm."""
    if not len(scores):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores, float(np.exp(log_t)))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    lo, hi, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    for _ in range(40):
        if loss(a) < loss(b):
            hi = b
        else:
            lo = a
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    return float(np.exp((lo + hi) / 2))
