"""Gradient-boosted trees for a yes-or-no label, in numpy.

Trees are grown on binned features with the logistic loss. A feature may be bound
to raise or to lower the score: a split that breaks the bound is not taken, and
the mid value of a split bounds what its branches may hold, so the whole ensemble
is monotone in that feature. The trees are flattened into arrays of nodes and all
rows walk down all trees together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Growth:
    trees: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    least_rows: int = 10
    ridge: float = 1.0


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees one after another; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        node = np.repeat(self.roots[None, :], len(rows), axis=0)
        line = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            node = np.where(rows[line, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(rows: np.ndarray, labels: np.ndarray, bounds: np.ndarray, growth: Growth = Growth()) -> Forest:
    """Fit a forest; ``bounds`` has +1, -1 or 0 per feature. Without rows every score is one half."""
    n = len(labels)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, growth.bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], axis=1) if n else np.zeros((0, len(cuts)), int)
    grower = _Grower(cuts, binned, bounds, growth)
    total = np.full(n, base)
    roots = []
    for _ in range(growth.trees if n else 0):
        p = 1 / (1 + np.exp(-total))
        roots.append(len(grower.feature))
        total = total + grower.grow(p - labels, p * (1 - p))
    arrays = [np.array(a, t) for a, t in zip((roots, grower.feature, grower.cut, grower.left, grower.right, grower.value), (int, int, float, int, int, float))]
    return Forest(*arrays, growth.depth, base)


class _Grower:
    def __init__(self, cuts: list[np.ndarray], binned: np.ndarray, bounds: np.ndarray, growth: Growth) -> None:
        self.cuts, self.binned, self.bounds, self.growth = cuts, binned, bounds, growth
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def grow(self, slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
        """Add one tree; returns what it adds to each training row."""
        added = np.zeros(len(slope))
        self._node(np.arange(len(slope)), slope, bend, 0, -np.inf, np.inf, added)
        return added

    def _weight(self, g, h, low: float, high: float):
        return np.clip(-g / (h + self.growth.ridge), low, high)

    def _gain(self, g, h, w):
        return -(g * w + 0.5 * (h + self.growth.ridge) * w * w)

    def _node(self, own: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int, low: float, high: float, added: np.ndarray) -> int:
        me = len(self.feature)
        g, h = slope[own].sum(), bend[own].sum()
        w = float(self._weight(g, h, low, high))
        for column, at_first in ((self.feature, 0), (self.cut, np.inf), (self.left, me), (self.right, me), (self.value, w * self.growth.rate)):
            column.append(at_first)
        best = self._best(own, slope, bend, g, h, low, high) if depth < self.growth.depth else None
        if best is None:
            added[own] = w * self.growth.rate
            return me
        f, k, w_left, w_right = best
        goes_left = self.binned[own, f] <= k
        middle = (w_left + w_right) / 2
        down = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(self.bounds[f])]
        self.feature[me], self.cut[me] = f, float(self.cuts[f][k])
        self.left[me] = self._node(own[goes_left], slope, bend, depth + 1, *down[0], added)
        self.right[me] = self._node(own[~goes_left], slope, bend, depth + 1, *down[1], added)
        return me

    def _best(self, own, slope, bend, g, h, low, high):
        best, found = 1e-6, None
        here = self._gain(g, h, self._weight(g, h, low, high))
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            bins, n = self.binned[own, f], len(cuts) + 1
            gl = np.cumsum(np.bincount(bins, slope[own], n))[:-1]
            hl = np.cumsum(np.bincount(bins, bend[own], n))[:-1]
            rows = np.cumsum(np.bincount(bins, minlength=n))[:-1]
            wl, wr = self._weight(gl, hl, low, high), self._weight(g - gl, h - hl, low, high)
            gain = self._gain(gl, hl, wl) + self._gain(g - gl, h - hl, wr) - here
            allowed = (rows >= self.growth.least_rows) & (len(own) - rows >= self.growth.least_rows) & (self.bounds[f] * (wr - wl) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = float(gain[k]), (f, k, float(wl[k]), float(wr[k]))
        return found
