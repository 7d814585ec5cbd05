"""Gradient-boosted trees for two classes, small enough to fit a bounded sample.

Features are cut into at most 32 bins by quantiles; trees of a fixed depth are stored
as a heap of (feature, threshold), so scoring is a few vector steps a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    base: float
    features: np.ndarray  # (trees, 2**depth - 1)
    thresholds: np.ndarray  # go right if the value is over it
    leaves: np.ndarray  # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row of x."""
        out = np.full(len(x), self.base)
        inner, rows = self.features.shape[1], np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Trees on x (rows by features) and labels y of 0 and 1; the same input, the same trees."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) if n else np.zeros(0) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]) if width else np.zeros((n, 0), int)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    margin, inner = np.full(n, base), 2**depth - 1
    features, thresholds, leaves = (np.zeros((rounds, inner), int), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1)))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            low, nodes = 2**level - 1, 2**level
            local = at - low
            best = np.full(nodes, 1e-6)
            total_g, total_h = np.bincount(local, grad, nodes), np.bincount(local, hess, nodes)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * (len(c) + 1) + binned[:, j]
                g = np.cumsum(np.bincount(key, grad, nodes * (len(c) + 1)).reshape(nodes, -1), axis=1)[:, :-1]
                h = np.cumsum(np.bincount(key, hess, nodes * (len(c) + 1)).reshape(nodes, -1), axis=1)[:, :-1]
                rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                gain = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain[(h < 0.5) | (rest_h < 0.5)] = 0
                k = gain.argmax(axis=1)
                found = gain[np.arange(nodes), k]
                better = found > best
                best[better] = found[better]
                features[r, low : low + nodes][better] = j
                thresholds[r, low : low + nodes][better] = c[k[better]]
            f, t = features[r, at], thresholds[r, at]
            at = 2 * at + 1 + (x[np.arange(n), f] > t)
        leaf = at - inner
        leaves[r] = rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
        margin += leaves[r][leaf]
    return Trees(base, features, thresholds, leaves)
