"""Histogram gradient-boosted trees for a binary label, in numpy. Trees are
complete to a fixed depth and kept as flat arrays, so scoring is a few
vectorised steps down for all rows and one tree at a time."""

from __future__ import annotations

import numpy as np

BINS = 64


class Trees:
    """feature, threshold (trees x inner nodes), value (trees x leaves), base."""

    def __init__(self, feature, threshold, value, base):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, l2: float = 5.0, least_rows: float = 5.0) -> Trees:
    """Logistic boosting. With no rows or a single label the result is a
    constant (the smoothed share of label 1)."""
    n, k = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner = 2 ** depth - 1
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if n < 2 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # x <= edge b: bin <= b
    cell = binned + np.arange(k) * BINS
    features, thresholds, values = [], [], []
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width = 2 ** level
            at = (node[:, None] * (k * BINS) + cell).ravel()
            size = width * k * BINS
            hist = [np.bincount(at, np.repeat(v, k), size).reshape(width, k, BINS).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gt, ht) = hist, [v[:, :, -1:] for v in hist]
            gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
            gain[(hl < least_rows / 4) | (ht - hl < least_rows / 4)] = 0
            for j, e in enumerate(edges):
                gain[:, j, len(e):] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            j, b = np.divmod(best, BINS)
            slots = width - 1 + np.arange(width)
            feature[slots] = np.where(split, j, 0)
            threshold[slots] = [edges[a][c] if s else np.inf for a, c, s in zip(j, b, split)]
            cut = np.where(split, b, BINS)
            node = 2 * node + (binned[np.arange(n), feature[slots][node]] > cut[node])
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        value = -rate * gs / (hs + l2)
        margin += value[node]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)
