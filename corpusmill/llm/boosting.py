"""Gradient-boosted trees for a two-class problem on numeric features, in numpy: logistic loss, second-order gains over histogram bins,
trees of fixed depth stored as arrays, prediction vectorised over rows."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``fit`` then ``logit``. ``bins`` quantile bins a feature, ``rounds`` trees of ``depth`` levels."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 5.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(np.unique(x[:, k]), np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = self._binned(x)
        width = max(len(e) for e in self.edges) + 1
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        f = np.full(len(y), self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, width, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                at = node - first
                best, where = np.full(n, 1e-6), [(0, width)] * n
                for k in range(x.shape[1]):
                    key = at * width + b[:, k]
                    gs = np.bincount(key, g, n * width).reshape(n, width).cumsum(1)
                    hs = np.bincount(key, h, n * width).reshape(n, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least * 0.05) | (ht - hs < self.least * 0.05)] = 0
                    j = gain.argmax(1)
                    for i in np.nonzero(gain[np.arange(n), j] > best)[0]:
                        best[i], where[i] = gain[i, j[i]], (k, int(j[i]))
                for i, (k, j) in enumerate(where):
                    feature[first + i], cut[first + i] = k, j
                node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - inner
            value = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += value[node - len(feature)]
        return f
