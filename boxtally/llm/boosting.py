"""Gradient-boosted regression trees for the logistic loss, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth stored as full binary trees: feature, threshold and leaf values."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: int = 8) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base = 0.0
        self.feature = np.zeros((trees, 2**depth - 1), np.int32)
        self.threshold = np.full((trees, 2**depth - 1), np.inf)
        self.leaf = np.zeros((trees, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Boosted":
        rows, cols = x.shape
        weight = np.ones(rows) if weight is None else weight
        mean = np.clip((y * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(cols)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(cols)], axis=1)
        score = np.full(rows, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = (y - p) * weight, p * (1 - p) * weight
            node = np.zeros(rows, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                pick = np.full(width, -1)
                cut = np.zeros(width, np.int64)
                for j in range(cols):
                    key = node * self.bins + binned[:, j]
                    size = width * self.bins
                    gs = np.bincount(key, g, size).reshape(width, -1).cumsum(axis=1)
                    hs = np.bincount(key, h, size).reshape(width, -1).cumsum(axis=1)
                    ns = np.bincount(key, minlength=size).reshape(width, -1).cumsum(axis=1)
                    gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs)**2 / (hs[:, -1:] - hs + 1) - gs[:, -1:]**2 / (hs[:, -1:] + 1)
                    gain[(ns < self.least) | (ns[:, -1:] - ns < self.least)] = 0
                    gain[:, len(edges[j]):] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better], pick[better], cut[better] = top[better], j, at[better]
                for n in range(width):
                    if pick[n] >= 0:
                        self.feature[t, first + n] = pick[n]
                        self.threshold[t, first + n] = edges[pick[n]][cut[n]]
                node = node * 2 + (x[np.arange(rows), self.feature[t, first + node]] > self.threshold[t, first + node])
            gs, hs = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            self.leaf[t] = self.rate * gs / (hs + 1)
            score += self.leaf[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                node = node * 2 + (x[rows, self.feature[t, first + node]] > self.threshold[t, first + node])
            score += self.leaf[t][node]
        return score
