"""Gradient-boosted trees on numpy: binary log loss, histogram splits, complete trees of fixed depth."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees as arrays: tree t at depth k asks feature[t, node] <= cut[t, node]; leaves add up to a log-odds score."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.cut, self.leaf, self.base = feature, cut, leaf, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 48, l2: float = 1.0) -> Boosted:
        """x: rows x features (float), y: 0 or 1."""
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
        coded = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)  # value <= edge k  <=>  code <= k
        prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        base = float(np.log(prior / (1 - prior)))
        score, nodes = np.full(n, base), 2**depth - 1
        feature = np.zeros((trees, nodes), np.int32)
        cut = np.full((trees, nodes), np.inf)
        leaf = np.zeros((trees, 2**depth))
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, count = 2**level - 1, 2**level
                local = at - first
                best = np.full(count, 1e-6)
                for j in range(width):
                    b = len(edges[j]) + 1
                    if b == 1:
                        continue
                    key = local * b + coded[:, j]
                    sg = np.bincount(key, g, count * b).reshape(count, b).cumsum(1)
                    sh = np.bincount(key, h, count * b).reshape(count, b).cumsum(1)
                    gt, ht = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + l2) + (gt - sg) ** 2 / (ht - sh + l2) - gt**2 / (ht + l2)
                    gain[:, -1] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(count), k]
                    better = top > best
                    best = np.where(better, top, best)
                    feature[t, first : first + count][better] = j
                    cut[t, first : first + count][better] = edges[j][np.minimum(k[better], len(edges[j]) - 1)]
                right = x[np.arange(n), feature[t, at]] > cut[t, at]
                at = 2 * at + 1 + right
            own = at - nodes
            leaf[t] = rate * np.bincount(own, g, 2**depth) / (np.bincount(own, h, 2**depth) + l2)
            score += leaf[t, own]
        return cls(feature, cut, leaf, base)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability per row."""
        out, rows, nodes = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while nodes and at[:1].size and at[0] < nodes:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - nodes]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))

    def state(self) -> dict:
        return {"feature": self.feature.tolist(), "cut": [[None if np.isinf(c) else round(float(c), 6) for c in row] for row in self.cut], "leaf": np.round(self.leaf, 5).tolist(), "base": self.base}

    @classmethod
    def load(cls, state: dict) -> Boosted:
        cut = np.array([[np.inf if c is None else c for c in row] for row in state["cut"]], float)
        return cls(np.array(state["feature"], np.int32), cut, np.array(state["leaf"], float), state["base"])
