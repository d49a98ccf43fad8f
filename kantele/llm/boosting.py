"""Gradient-boosted trees for two classes, with monotonic constraints, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS, TREES, DEPTH, RATE, SMOOTHING, LEAST = 64, 60, 4, 0.2, 1.0, 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


@dataclass
class Trees:
    """All trees in flat node arrays; a leaf is its own child and holds a value."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row: all trees of all rows go down one level at a time."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(goes, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


class _Grower:
    def __init__(self, bins: np.ndarray, cuts: list[np.ndarray], signs: np.ndarray, depth: int):
        self.bins, self.cuts, self.signs, self.depth = bins, cuts, signs, depth
        self.nodes: list[list] = []

    def leaf(self, value: float) -> int:
        at = len(self.nodes)
        self.nodes.append([0, 0.0, at, at, value])
        return at

    def split(self, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, low: float, high: float):
        best = (1e-9, None)
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        whole = g_all**2 / (h_all + SMOOTHING)
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            binned = self.bins[rows, f]
            size = len(cuts) + 1
            g, h, n = (np.bincount(binned, w, size).cumsum()[:-1] for w in (grad[rows], hess[rows], None))
            value_l, value_r = (np.clip(-a / (b + SMOOTHING), low, high) for a, b in ((g, h), (g_all - g, h_all - h)))
            gain = sum(-(2 * a * v + (b + SMOOTHING) * v * v) for a, b, v in ((g, h, value_l), (g_all - g, h_all - h, value_r))) - whole
            gain[(n < LEAST) | (len(rows) - n < LEAST)] = -1
            if self.signs[f]:
                gain[self.signs[f] * (value_r - value_l) < 0] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = gain[at], (f, at, float(value_l[at]), float(value_r[at]))
        return best[1]

    def grow(self, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int = 0, low: float = -4.0, high: float = 4.0) -> int:
        value = float(np.clip(-grad[rows].sum() / (hess[rows].sum() + SMOOTHING), low, high))
        found = self.split(rows, grad, hess, low, high) if level < self.depth else None
        if found is None:
            return self.leaf(value)
        f, cut, value_l, value_r = found
        at = self.leaf(0.0)
        goes = self.bins[rows, f] <= cut
        bounds = (low, high), (low, high)
        if self.signs[f]:
            # Values below the split stay on their side of the middle.
            middle = (value_l + value_r) / 2
            bounds = ((low, middle), (middle, high)) if self.signs[f] > 0 else ((middle, high), (low, middle))
        left = self.grow(rows[goes], grad, hess, level + 1, *bounds[0])
        right = self.grow(rows[~goes], grad, hess, level + 1, *bounds[1])
        self.nodes[at] = [f, float(self.cuts[f][cut]), left, right, 0.0]
        return at


def fit(x: np.ndarray, y: np.ndarray, signs=None, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Trees for P(y = 1).

    ``signs`` has for each feature 1 (the score never falls as it rises), -1 (never
    rises) or 0. Without rows of both classes the score is constant: 1 if there is
    no row of class 0, else 0.
    """
    signs = np.zeros(x.shape[1]) if signs is None else np.asarray(signs)
    share = float(y.mean()) if len(y) else 1.0
    if share in (0.0, 1.0):
        one = np.zeros(1, np.int64)
        return Trees(30.0 if share else -30.0, one, one, np.zeros(1), one, one, np.zeros(1), 0)
    cuts = []
    for column in x.T:
        points = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        cuts.append(points[points < column.max()])
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    grower, roots = _Grower(binned, cuts, signs, depth), []
    rows = np.arange(len(y))
    for _ in range(trees):
        p = sigmoid(margin)
        root = grower.grow(rows, p - y, np.maximum(p * (1 - p), 1e-6))
        roots.append(root)
        feature, threshold, left, right, value = (np.array(c) for c in zip(*grower.nodes, strict=True))
        one = Trees(0.0, np.array([root]), feature, threshold, left, right, value, depth)
        margin += rate * one.margin(x)
    return Trees(base, np.array(roots), feature, threshold, left, right, rate * value, depth)
