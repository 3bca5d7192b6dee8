"""Gradient-boosted trees on a bounded sample, kept as flat node arrays.

Logistic loss, second-order gains on quantile bins, and monotonic constraints: a split on a
constrained feature must order its two leaves, and the middle of the two bounds all values below.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in one array each; a leaf's feature is -1. roots: the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row of x reaches; all trees advance by one level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            step = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(inner, step, node)
        return self.base + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 64, least: float = 2.0) -> Forest:
    """Trees for y in {0, 1}. signs: for each feature 1 if the score may only rise with it, -1 if only fall, 0 if either.

    least is the smallest sum of second derivatives in a leaf. Rows with no label variety give a
    forest without splits, and no rows one that scores 0.5.
    """
    nodes: list[list] = []
    roots = []
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(len(signs))]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if len(x) else np.empty((0, len(signs)), int)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(np.clip(-gs / (hs + ridge), low, high))
        nodes.append([-1, 0.0, 0, 0, rate * leaf])
        if level == depth or len(rows) < 2:
            return at
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            lg = np.bincount(binned[rows, j], g[rows], len(c) + 1).cumsum()[:-1]
            lh = np.bincount(binned[rows, j], h[rows], len(c) + 1).cumsum()[:-1]
            wl, wr = np.clip(-lg / (lh + ridge), low, high), np.clip(-(gs - lg) / (hs - lh + ridge), low, high)
            value = lambda w, a, b: -(a * w + 0.5 * (b + ridge) * w * w)  # noqa: E731  what a leaf of weight w gains
            gain = value(wl, lg, lh) + value(wr, gs - lg, hs - lh) - value(leaf, gs, hs)
            bad = (lh < least) | (hs - lh < least) | (signs[j] * (wr - wl) < 0)
            k = int(np.argmax(np.where(bad, -np.inf, gain)))
            if not bad[k] and gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(wl[k]), float(wr[k]))
        if best[1] < 0:
            return at
        _, j, k, wl, wr = best
        middle = (wl + wr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[j]]
        goes = binned[rows, j] <= k
        left = grow(rows[goes], g, h, level + 1, *bounds[0])
        right = grow(rows[~goes], g, h, level + 1, *bounds[1])
        nodes[at][:4] = j, float(cuts[j][k]), left, right
        return at

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        feature, threshold, left, right, value = (np.array(v) for v in zip(*nodes))
        tree = Forest(feature.astype(np.int32), threshold, left.astype(np.int32), right.astype(np.int32), value, np.array([first]), 0.0, depth)
        margin += tree.margin(x)
    if not nodes:
        nodes.append([-1, 0.0, 0, 0, 0.0])
        roots.append(0)
    feature, threshold, left, right, value = (np.array(v) for v in zip(*nodes))
    return Forest(feature.astype(np.int32), threshold.astype(float), left.astype(np.int32), right.astype(np.int32), value.astype(float), np.array(roots), base, depth)
