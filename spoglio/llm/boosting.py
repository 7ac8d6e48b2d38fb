"""Gradient-boosted trees for two classes on small numeric tables: logistic loss, histogram splits, Newton leaves."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: int = 8, penalty: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.penalty = rounds, depth, rate, bins, least, penalty
        self.trees: list = []  # each: arrays of feature or -1, threshold, left, right, value
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        share = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree: list[tuple[int, float, int, int, float]] = []
            self._grow(tree, np.arange(len(y)), binned, cuts, g, h, score, 0)
            self.trees.append(tree)
        self.trees = [tuple(np.array(c) for c in zip(*tree)) for tree in self.trees]
        return self

    def _grow(self, tree, rows, binned, cuts, g, h, score, level) -> int:
        at, total_g, total_h = len(tree), g[rows].sum(), h[rows].sum()
        tree.append((-1, 0.0, -1, -1, 0.0))
        best = (1e-6, -1, 0)
        if level < self.depth and len(rows) >= 2 * self.least:
            width = self.bins + 1
            b = (binned[rows] + np.arange(binned.shape[1]) * width).ravel()
            sums = [np.bincount(b, weights=None if w is None else np.repeat(w[rows], binned.shape[1]), minlength=binned.shape[1] * width).reshape(-1, width).cumsum(1)[:, :-1] for w in (g, h, None)]
            ok = (sums[2] >= self.least) & (len(rows) - sums[2] >= self.least) & (np.arange(width - 1) < np.array([len(c) for c in cuts])[:, None])
            gain = np.where(ok, sums[0] ** 2 / (sums[1] + self.penalty) + (total_g - sums[0]) ** 2 / (total_h - sums[1] + self.penalty) - total_g**2 / (total_h + self.penalty), -1)
            j, k = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, k] > best[0]:
                best = (float(gain[j, k]), int(j), int(k))
        if best[1] < 0:
            value = self.rate * total_g / (total_h + self.penalty)
            score[rows] += value
            tree[at] = (-1, 0.0, -1, -1, float(value))
            return at
        j, k = best[1], best[2]
        left = binned[rows, j] <= k
        l = self._grow(tree, rows[left], binned, cuts, g, h, score, level + 1)
        r = self._grow(tree, rows[~left], binned, cuts, g, h, score, level + 1)
        tree[at] = (j, float(cuts[j][k]), l, r, 0.0)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        x = np.asarray(x, dtype=float)
        score = np.full(len(x), self.base)
        for tree in self.trees:
            feature, cut, left, right, value = tree
            at = np.zeros(len(x), dtype=int)
            while (feature[at] >= 0).any():
                inner = feature[at] >= 0
                f = feature[at[inner]]
                below = x[np.flatnonzero(inner), f] <= cut[at[inner]]
                at[inner] = np.where(below, left[at[inner]], right[at[inner]])
            score += value[at]
        return 1 / (1 + np.exp(-score))
