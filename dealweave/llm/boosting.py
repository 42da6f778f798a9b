"""Gradient-boosted regression trees for two classes, on binned features (numpy only)."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of complete trees of a fixed depth over quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, min_rows: int = 8, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.min_rows, self.l2 = trees, depth, rate, bins, min_rows, l2
        self.base = 0.0
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, m = x.shape
        w = np.ones(n) if weight is None else weight
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        p = np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        width = self.bins
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            grad, hess = w * (y - q), w * q * (1 - q)
            inner = (1 << self.depth) - 1
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                count, first = 1 << level, (1 << level) - 1
                local = node - first
                best_gain = np.full(count, 1e-9)
                best_f, best_c = np.zeros(count, dtype=np.int64), np.full(count, width, dtype=np.int64)
                for j in range(m):
                    slot = local * width + code[:, j]
                    g = np.bincount(slot, grad, count * width).reshape(count, width)
                    h = np.bincount(slot, hess, count * width).reshape(count, width)
                    c = np.bincount(slot, minlength=count * width).reshape(count, width)
                    gl, hl, cl = g.cumsum(1), h.cumsum(1), c.cumsum(1)
                    gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(cl < self.min_rows) | (ct - cl < self.min_rows)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(count), at]
                    better = top > best_gain
                    best_gain[better], best_f[better], best_c[better] = top[better], j, at[better]
                feature[first : first + count] = best_f
                for k in range(count):
                    e = edges[best_f[k]]
                    cut[first + k] = e[best_c[k]] if best_c[k] < len(e) else np.inf
                right = code[np.arange(n), best_f[local]] > best_c[local]
                node = 2 * node + 1 + right
            at = node - inner
            leaves = 1 << self.depth
            value = self.rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + self.l2)
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(value)
            f += value[at]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        out = np.full(n, self.base)
        rows = np.arange(n)
        inner = (1 << self.depth) - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(n, dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out
