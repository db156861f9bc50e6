"""Gradient-boosted trees in numpy, with monotonic constraints, scored from flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in one set of arrays; a leaf points to itself on both sides."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values: every row walks every tree at once, level by level."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(below, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass
class _Nodes:
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self) -> int:
        k = len(self.value)
        for a, v in ((self.feature, 0), (self.threshold, 0.0), (self.left, k), (self.right, k), (self.value, 0.0)):
            a.append(v)
        return k


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: int = 10) -> Forest:
    """Logistic boosting on histogram splits.

    monotone: per feature 1 (the score may not fall as it rises), -1 or 0. A split on a
    constrained feature is taken only if its sides' values are in order, and bounds
    at the middle of the two are handed down, so the whole tree keeps the order.
    """
    n, m = x.shape
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    nodes, roots = _Nodes(), []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1) if n else np.zeros((0, m), int)
    margin = np.full(n, base)

    def grow(k: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.value[k] = rate * float(np.clip(-gs / (hs + l2), low, high))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j in range(m):
                size = len(cuts[j]) + 1
                b = binned[rows, j]
                gl, hl = np.cumsum(np.bincount(b, g[rows], size))[:-1], np.cumsum(np.bincount(b, h[rows], size))[:-1]
                cl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                if not len(gl):
                    continue
                wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                ok = (cl >= least) & (len(rows) - cl >= least) & (monotone[j] * (wr - wl) >= 0)
                gain = np.where(ok, gain, -1)
                c = int(gain.argmax())
                if gain[c] > best[0]:
                    best = (float(gain[c]), (j, c, float(wl[c]), float(wr[c])))
        if best[1] is None:
            return
        j, c, wl, wr = best[1]
        nodes.feature[k], nodes.threshold[k] = j, float(cuts[j][c])
        nodes.left[k], nodes.right[k] = nodes.add(), nodes.add()
        mid, on_left = (wl + wr) / 2, binned[rows, j] <= c
        up, down = monotone[j] > 0, monotone[j] < 0
        grow(nodes.left[k], rows[on_left], g, h, mid if down else low, mid if up else high, level + 1)
        grow(nodes.right[k], rows[~on_left], g, h, mid if up else low, mid if down else high, level + 1)

    def flat() -> Forest:
        ints = (np.asarray(a, np.int32) for a in (nodes.feature, nodes.left, nodes.right))
        feature, left, right = ints
        return Forest(base, np.asarray(roots, np.int32), feature, np.asarray(nodes.threshold), left, right, np.asarray(nodes.value), depth)

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(nodes.add())
        first = roots[-1]
        grow(first, np.arange(n), p - y, p * (1 - p), -np.inf, np.inf, 0)
        one = flat()
        one.base, one.roots = 0.0, np.asarray([first], np.int32)
        margin += one.margin(x)
    if not roots:
        roots.append(nodes.add())
    return flat()
