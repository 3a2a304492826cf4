"""Sparse linear classifiers: follow-the-regularised-leader with elastic-net penalties, in numpy, over a bounded sample."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: feature numbers and values of all rows, end to end."""

    def __init__(self, features: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.start = np.concatenate([[0], np.cumsum([len(f) for f in features])]).astype(np.int64)
        self.features = np.concatenate([np.zeros(0, np.int64), *features]).astype(np.int64)
        self.values = np.concatenate([np.zeros(0), *values]) if values is not None else np.ones(len(self.features))

    def __len__(self):
        return len(self.start) - 1

    def take(self, rows: np.ndarray):
        """(row number within the selection, features, values)."""
        size = self.start[rows + 1] - self.start[rows]
        row = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[rows], size)
        return row, self.features[at], self.values[at]


def products(row: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Sums over the entries of each row; weights holds a row for each entry."""
    return np.column_stack([np.bincount(row, values * weights[:, k], minlength=n) for k in range(weights.shape[1])])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Ftrl:
    """FTRL-proximal: per-coordinate steps; l1 keeps weights at zero, l2 shrinks them."""

    def __init__(self, n_features: int, n_out: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((n_features, n_out)), np.zeros((n_features, n_out))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias = np.zeros(n_out)
        self.bias_n = np.full(n_out, 1e-6)

    def weights(self, f=slice(None)) -> np.ndarray:
        z = self.z[f]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[f])) / self.alpha + self.l2), 0.0)

    def step(self, f: np.ndarray, w: np.ndarray, g: np.ndarray, bias_g: np.ndarray) -> None:
        n = self.n[f]
        self.z[f] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[f] = n + g * g
        self.bias_n += bias_g**2
        self.bias -= self.alpha * bias_g / (self.beta + np.sqrt(self.bias_n))


def fit_softmax(x: Rows, y: np.ndarray, n_features: int, n_classes: int, alpha=0.3, beta=1.0, l1=0.02, l2=0.01, epochs=6, batch=64, seed=7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and biases of a multinomial logistic regression."""
    model, rng = Ftrl(n_features, n_classes, alpha, beta, l1, l2), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            row, f, v = x.take(rows)
            u, at = np.unique(f, return_inverse=True)
            w = model.weights(u)
            error = softmax(products(row, v, w[at], len(rows)) + model.bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            g = products(at, v, error[row], len(u))
            model.step(u, w, g, error.sum(axis=0))
    return model.weights(), model.bias


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(z / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean()

    a, b, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
