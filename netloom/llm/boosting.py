"""Gradient-boosted trees for two classes, in numpy: histogram splits, monotonic constraints, flattened for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees flattened into arrays of shape (trees, nodes): an inner node sends x[feature] <= threshold to its left child,
    the other one stands next to it; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for the rows of x: all rows step down one level of one tree at a time."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, l, v in zip(self.feature, self.threshold, self.left, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = l[node] != node
                node = np.where(inner, l[node] + (inner & (x[rows, f[node]] > t[node])), node)
            out += v[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _leaf(g: float, h: float, l2: float, low: float, high: float) -> float:
    return float(np.clip(-g / (h + l2), low, high))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Forest:
    """monotone: for each feature +1 (the score never falls as it grows), -1 (never rises) or 0.

    A constrained split must have its children's values in order, and their mean bounds all values below, so a whole tree
    is monotonic and so is the sum."""
    n, d = x.shape
    p = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
    base, width = float(np.log(p / (1 - p))), 2 ** (depth + 1)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], 1) if n else np.zeros((0, d), np.int64)
    score = np.full(n, base)
    out = {k: np.zeros((trees, width), t) for k, t in (("feature", np.int64), ("threshold", np.float64), ("left", np.int64), ("value", np.float64))}
    for t in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        out["left"][t] = np.arange(width)
        free, todo = 1, [(0, np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            out["value"][t, node] = rate * _leaf(gs, hs, l2, low, high)
            best = (1e-6, None)
            if level < depth and len(rows) > 1:
                for j in range(d):
                    if not len(cuts[j]):
                        continue
                    size = len(cuts[j]) + 1
                    gl = np.cumsum(np.bincount(code[rows, j], g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, j], h[rows], size))[:-1]
                    lv, rv = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                    ok = (hl >= least * 0.1) & (hs - hl >= least * 0.1) & (monotone[j] * (rv - lv) >= 0)
                    gain = np.where(ok, gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2), -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (j, k, float(lv[k]), float(rv[k])))
            if best[1] is None:
                score[rows] += out["value"][t, node]
                continue
            j, k, lv, rv = best[1]
            out["feature"][t, node], out["threshold"][t, node], out["left"][t, node] = j, cuts[j][k], free
            goes = code[rows, j] <= k
            mid = (lv + rv) / 2
            bounds = [(low, high), (low, high)] if not monotone[j] else [(low, mid), (mid, high)] if monotone[j] > 0 else [(mid, high), (low, mid)]
            todo += [(free, rows[goes], level + 1, *bounds[0]), (free + 1, rows[~goes], level + 1, *bounds[1])]
            free += 2
    return Forest(out["feature"], out["threshold"], out["left"], out["value"], base, depth)
