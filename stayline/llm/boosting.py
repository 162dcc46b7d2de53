"""Gradient-boosted trees with monotone constraints, kept as flat numpy node arrays.

Fitting works on a bounded sample in the driver's memory; scoring is a handful of array
lookups per tree level and runs inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth; node i has the children 2i+1 and 2i+2.

    ``feature`` and ``threshold`` are (trees, 2**depth - 1), ``leaf`` is (trees, 2**depth).
    A row goes right where its value is above the threshold; NaN goes left.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    @property
    def depth(self) -> int:
        return self.leaf.shape[1].bit_length() - 1

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray,
    rounds: int = 60,
    depth: int = 4,
    step: float = 0.15,
    bins: int = 64,
    penalty: float = 1.0,
    least: float = 1.0,
) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins.

    ``monotone`` holds -1, 0 or 1 for each feature. A split on a constrained feature is
    taken only if its leaf values stand in the asked order, and both subtrees are then
    held on their side of the middle, so the whole model is monotone.
    """
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features = np.zeros((rounds, inner), np.int64)
    thresholds = np.full((rounds, inner), np.inf)
    values = np.zeros((rounds, leaves))
    offsets = np.arange(width) * bins
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * leaves, -np.inf), np.full(2 * leaves, np.inf)
        for i in range(inner):
            low[[2 * i + 1, 2 * i + 2]], high[[2 * i + 1, 2 * i + 2]] = low[i], high[i]
            rows = np.flatnonzero(node == i)
            if len(rows):
                slots = (binned[rows] + offsets).ravel()
                g = np.bincount(slots, np.repeat(gradient[rows], width), width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(slots, np.repeat(weight[rows], width), width * bins).reshape(width, bins).cumsum(1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                left = np.clip(g / (h + penalty), low[i], high[i])
                right = np.clip((g_all - g) / (h_all - h + penalty), low[i], high[i])

                def loss(v, g, h):
                    return g * v - 0.5 * (h + penalty) * v * v

                whole = np.clip(g_all / (h_all + penalty), low[i], high[i])
                gain = loss(left, g, h) + loss(right, g_all - g, h_all - h) - loss(whole, g_all, h_all)
                ordered = (right - left) * monotone[:, None] >= 0
                gain = np.where(ordered & (h >= least) & (h_all - h >= least), gain, -np.inf)
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > 1e-9 and b < len(cuts[j]):
                    features[t, i], thresholds[t, i] = j, cuts[j][b]
                    if monotone[j]:
                        middle = (left[j, b] + right[j, b]) / 2
                        below, above = (2 * i + 1, 2 * i + 2) if monotone[j] > 0 else (2 * i + 2, 2 * i + 1)
                        high[below], low[above] = min(high[below], middle), max(low[above], middle)
                node[rows] = 2 * i + 1 + (x[rows, features[t, i]] > thresholds[t, i])
        at = node - inner
        total = np.bincount(at, gradient, leaves)
        values[t] = step * np.clip(
            total / (np.bincount(at, weight, leaves) + penalty), low[inner : inner + leaves], high[inner : inner + leaves]
        )
        margin += values[t][at]
    return Trees(features, thresholds, values, base)
