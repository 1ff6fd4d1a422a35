"""Gradient-boosted trees for a yes/no target, on numpy arrays."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, Newton leaves, full binary trees of fixed depth over quantile cuts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 16, ridge: float = 1.0):
        self.depth, n = depth, len(y)
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, f], side="left") + f * bins for f, c in enumerate(cuts)], axis=1)
        width, limit = x.shape[1] * bins, np.full((x.shape[1], bins), np.inf)
        for f, c in enumerate(cuts):
            limit[f, : len(c)] = c
        limit = limit.ravel()
        margin, self.feature, self.cut, self.leaf = np.full(n, self.bias), [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            feature, cut, node = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf), np.zeros(n, np.int64)
            for level in range(depth):
                first, many = (1 << level) - 1, 1 << level
                at = ((node - first)[:, None] * width + code).ravel()
                g, h = (np.bincount(at, np.repeat(v, x.shape[1]), many * width).reshape(many, -1, bins).cumsum(axis=2) for v in (grad, hess))
                gain = (g**2 / (h + ridge) + (g[:, :, -1:] - g) ** 2 / (h[:, :, -1:] - h + ridge) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + ridge)).reshape(many, -1)
                gain[:, np.isinf(limit)] = 0
                best = gain.argmax(axis=1)
                good = gain[np.arange(many), best] > 1e-9
                feature[first : first + many] = np.where(good, best // bins, 0)
                cut[first : first + many] = np.where(good, limit[best], np.inf)
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            spot = node - ((1 << depth) - 1)
            leaf = rate * np.bincount(spot, grad, 1 << depth) / (np.bincount(spot, hess, 1 << depth) + ridge)
            margin = margin + leaf[spot]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out
