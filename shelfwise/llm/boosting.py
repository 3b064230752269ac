"""Gradient-boosted trees for a 0/1 label, on binned feature tables.

Trees grow level by level from histograms of gradients by (node, feature, bin). These are sums
of whole numbers, so they may come from arrays or be added up over the parts of a table of any
size, in any order, with the same trees.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

UNIT = 2.0**30  # gradients are counted in whole parts of 1 / UNIT


class Boosted:
    """Depth-limited trees on quantile bins, logistic loss, Newton leaf values."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple] = []
        self.start = 0.0

    def quantiles(self) -> list[float]:
        """Those whose distinct values are the edges of a feature's bins."""
        return np.linspace(0, 1, self.bins + 1)[1:-1].tolist()

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], self.quantiles())) for j in range(x.shape[1])]
        n = np.ones(len(y), np.int64)
        return self.grow(edges, len(y), int(y.sum()), lambda splits, level: self.histograms(x, y, n, splits, level))

    def grow(self, edges: list[np.ndarray], rows: int, positives: int, histograms: Callable[[dict, int], np.ndarray]) -> Boosted:
        """Trees from ``histograms(splits, level)``, what ``histograms`` gives over all rows."""
        self.edges, self.trees = edges, []
        rate = (positives + 1) / (rows + 2)
        self.start = float(np.log(rate / (1 - rate)))
        for _ in range(self.rounds):
            self.trees.append(self._grown(histograms))
        return self

    def histograms(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, splits: dict, level: int) -> np.ndarray:
        """Sums of gradients and curvatures of rows that count ``n`` times: ``(2, node, feature, bin)``.

        ``splits`` are those of the tree that grows, ``{node: (feature, cut)}``; the root is node
        1, the children of a node are twice it and the next. Its nodes of ``level`` are summed.
        """
        b = self._binned(x)
        p = 1 / (1 + np.exp(-self._sum(b)))
        sums = [np.rint(v * UNIT).astype(np.int64) * n for v in (p - y, p * (1 - p) + 1e-6)]
        at = np.ones(len(b), np.int64)
        for node in sorted(splits):
            own = at == node
            j, cut = splits[node]
            at[own] = 2 * node + (b[own, j] > cut)
        first = 1 << level
        out = np.zeros((2, first, len(self.edges), self.bins), np.int64)
        own = np.flatnonzero(at >= first)
        for j in range(len(self.edges)):
            for v, s in zip(out, sums):
                np.add.at(v[:, j], (at[own] - first, b[own, j]), s[own])
        return out

    def _grown(self, histograms) -> tuple:
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, float] = {}
        for level in range(self.depth):
            first = 1 << level
            for i, (g, h) in enumerate(zip(*(histograms(splits, level) / UNIT))):
                node = first + i
                if level and node // 2 not in splits:
                    continue
                total_g, total_h = g[0].sum(), h[0].sum()
                leaves[node] = -total_g / (total_h + 1)
                left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                right_g, right_h = total_g - left_g, total_h - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
                gain[np.minimum(left_h, right_h) * 4 < self.least / 4] = 0
                if gain.max() <= 1e-6:
                    continue
                j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
                splits[node] = int(j), int(cut)
                leaves[2 * node] = -left_g[j, cut] / (left_h[j, cut] + 1)
                leaves[2 * node + 1] = -right_g[j, cut] / (right_h[j, cut] + 1)
            if not any(node >= first for node in splits):
                break

        def below(node):
            return (*splits[node], below(2 * node), below(2 * node + 1)) if node in splits else (float(leaves[node]),)

        return below(1)

    def _sum(self, b: np.ndarray) -> np.ndarray:
        f = np.full(len(b), self.start)
        for t in self.trees:
            f += self.rate * self._walk(t, b)
        return f

    def _walk(self, tree, b):
        if len(tree) == 1:
            return np.full(len(b), tree[0])
        j, cut, low, high = tree
        return np.where(b[:, j] <= cut, self._walk(low, b), self._walk(high, b))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self._sum(self._binned(x))))
