"""Sparse linear classifiers that the driver fits on a bounded sample: follow-the-regularised-leader and calibration."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Multinomial logistic regression by FTRL-Proximal with L1 and L2 penalties; weights are read from the state."""

    def __init__(self, dims: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.bias, self.bias_n = np.zeros(classes), np.zeros(classes)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights(at) + self.bias

    def push(self, at: np.ndarray, grad: np.ndarray, w: np.ndarray) -> None:
        n = self.n[at]
        self.z[at] += grad - (np.sqrt(n + grad * grad) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + grad * grad

    def step(self, at: np.ndarray, x: np.ndarray, label: int, cost: float = 1.0) -> None:
        """One example: distinct features at, their values x."""
        w = self.weights(at)
        p = softmax(x @ w + self.bias)
        p[label] -= 1
        p *= cost
        self.push(at, x[:, None] * p, w)
        self.bias_n += p * p
        self.bias -= self.alpha * p / (self.beta + np.sqrt(self.bias_n))

    def agree(self, at: np.ndarray, change: np.ndarray, penalty: float) -> None:
        """Penalty on the squared change of the logits when the values change by `change`."""
        w = self.weights(at)
        self.push(at, 2 * penalty * change[:, None] * (change @ w), w)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The positive scale that dividing the logits by gives the least negative log-likelihood; 1 without examples."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() + 1e-4 * abs(np.log(t)) for t in grid]
    return float(grid[int(np.argmin(loss))])
