"""A binary tree-structured graphical model: features score each node, potentials score each parent-child pair."""

from __future__ import annotations

import math

import numpy as np


class Forest:
    """Many trees in one set of arrays; parents come before their children, roots have parent -1."""

    def __init__(self, parent: np.ndarray, kind: np.ndarray, node: np.ndarray, feature: np.ndarray):
        self.parent, self.kind, self.node, self.feature = parent, kind, node, feature
        depth = np.zeros(len(parent), np.int64)
        # parents precede children: pointer jumping finds depths in as many rounds as the depth has bits
        up, step = parent.copy(), (parent >= 0).astype(np.int64)
        while (up >= 0).any():
            live = np.flatnonzero(up >= 0)
            step[live] += step[up[live]]
            up[live] = up[up[live]]
        depth = step
        order = np.argsort(depth, kind="stable")
        edge = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(edge[:-1], edge[1:])]


FEW = 2  # levels of so few nodes are walked node by node: a deep page is a long chain of them


def _lse2(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class TreeModel:
    """weight: by feature, for state 1; pair: by kind of edge, parent's state and child's state."""

    def __init__(self, features: int, kinds: int):
        self.weight, self.pair = np.zeros(features), np.zeros((kinds, 2, 2))

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product, upward then downward: marginal of state 1 for each node, and of both states for each edge."""
        n = len(f.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(f.node, self.weight[f.feature], minlength=n)
        sent, got = np.zeros((n, 2)), np.zeros((n, 2))
        pairs = self.pair.tolist()
        for level in f.levels[:0:-1]:
            if len(level) > FEW:
                sent[level] = _lse(self.pair[f.kind[level]] + own[level][:, None, :], 2)
                np.add.at(own, f.parent[level], sent[level])
                continue
            for e, up, kind in zip(level.tolist(), f.parent[level].tolist(), f.kind[level].tolist()):
                (p00, p01), (p10, p11) = pairs[kind]
                x, y = own[e].tolist()
                sent[e] = a, b = _lse2(p00 + x, p01 + y), _lse2(p10 + x, p11 + y)
                own[up, 0] += a
                own[up, 1] += b
        for level in f.levels[1:]:
            if len(level) > FEW:
                up = f.parent[level]
                got[level] = _lse((own[up] + got[up] - sent[level])[:, :, None] + self.pair[f.kind[level]], 1)
                continue
            for e, up, kind in zip(level.tolist(), f.parent[level].tolist(), f.kind[level].tolist()):
                (p00, p01), (p10, p11) = pairs[kind]
                x, y = (own[up] + got[up] - sent[e]).tolist()
                got[e] = _lse2(x + p00, y + p10), _lse2(x + p01, y + p11)
        inner = np.flatnonzero(f.parent >= 0)
        up, edge = f.parent[inner], np.zeros((n, 2, 2))
        full = (own[up] + got[up] - sent[inner])[:, :, None] + self.pair[f.kind[inner]] + own[inner][:, None, :]
        edge[inner] = np.exp(full - full.max(axis=(1, 2), keepdims=True))
        edge[inner] /= edge[inner].sum(axis=(1, 2), keepdims=True)
        both = own + got
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), edge

    def fit(self, f: Forest, label: np.ndarray, rounds: int = 250, rate: float = 0.15, ridge: float = 1e-3) -> TreeModel:
        """Gradient ascent (with moments) on the exact log-likelihood: what is seen minus what the marginals expect."""
        inner = f.parent >= 0
        seen_w = np.bincount(f.feature, label[f.node], minlength=len(self.weight))
        seen_p = np.zeros_like(self.pair)
        np.add.at(seen_p, (f.kind[inner], label[f.parent[inner]], label[inner]), 1)
        value = np.r_[self.weight, self.pair.ravel()]
        m, v = np.zeros_like(value), np.zeros_like(value)
        for t in range(1, rounds + 1):
            node, edge = self.messages(f)
            w = seen_w - np.bincount(f.feature, node[f.node], minlength=len(self.weight))
            p = seen_p.copy()
            np.subtract.at(p, f.kind[inner], edge[inner])
            g = np.r_[w, p.ravel()] / len(label) - ridge * value
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            value = value + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.weight, self.pair = value[: len(self.weight)], value[len(self.weight) :].reshape(self.pair.shape)
        return self
