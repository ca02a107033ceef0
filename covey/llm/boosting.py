"""Gradient-boosted trees for one yes/no target and isotonic calibration, in numpy, for samples that fit a driver."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Second-order boosting of depth-limited trees over quantile bins; scores are log-odds."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, features = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(features)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1)
        mean = (y.sum() + 0.5) / (n + 1)
        self.base, self.grown = float(np.log(mean / (1 - mean))), []
        score = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, p - y, np.maximum(p * (1 - p), 1e-6))
            self.grown.append(tree)
            score += tree[2][self._leaf(binned, tree)]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        """Level-wise: feature and bin for each inner node in heap order, and leaf values."""
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-9)
            local = node - first
            for j in range(binned.shape[1]):
                key = local * (self.bins + 1) + binned[:, j]
                gs = np.bincount(key, g, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(hs < self.least / 4) | (ht - hs < self.least / 4)] = 0
                at = gain.argmax(1)
                better = gain[np.arange(width), at] > best
                best = np.where(better, gain[np.arange(width), at], best)
                feature[first : first + width][better] = j
                cut[first : first + width][better] = at[better]
            node = 2 * node + 1 + (binned[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return feature, cut, -self.rate * gs / (hs + self.ridge)

    def _leaf(self, binned: np.ndarray, tree: tuple) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, tree[0][node]] > tree[1][node])
        return node - (2**self.depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1)
        score = np.full(len(x), self.base)
        for tree in self.grown:
            score += tree[2][self._leaf(binned, tree)]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing map from score to probability nearest to ``y``, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    values, first = np.unique(score[order], return_index=True)
    total, weight = np.add.reduceat(y[order].astype(float), first), np.diff(np.r_[first, len(y)]).astype(float)
    pools: list[list[float]] = []
    for v, t, w in zip(values, total, weight):
        pools.append([v, v, t, w])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            b = pools.pop()
            pools[-1] = [pools[-1][0], b[1], pools[-1][2] + b[2], pools[-1][3] + b[3]]
    x = np.array([v for p in pools for v in p[:2]])
    # one pseudo-count of the overall rate keeps small end pools off 0 and 1
    rate = (y.sum() + 0.5) / (len(y) + 1)
    fit = np.repeat([(p[2] + rate) / (p[3] + 1) for p in pools], 2)
    return x, np.maximum.accumulate(fit)
