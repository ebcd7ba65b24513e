"""Vantage-point trees over 64-bit fingerprints.

A node has a vantage point and a radius: fingerprints within the radius go to the
inner branch, the others to the outer one. Two fingerprints at distance r differ
by at most r in their distance to any vantage point, so a pair that a node parts has its
inner member within r of the boundary. That member goes to the outer branch as
well. Every pair within r thus meets in some leaf, and only boundary members
are in more than one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CANDIDATES = 8
BRUTE = 192


@dataclass(frozen=True)
class Tree:
    """Nodes of a tree over shards; a child below 0 is the leaf ``-child - 1``."""

    vantage: np.ndarray
    cut: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    leaves: int

    def shards(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of ``points`` and the leaf of each place where they belong."""
        rows, leaves = [], []
        todo = [(0 if len(self.cut) else -1, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                rows.append(own)
                leaves.append(np.full(len(own), -node - 1, np.int32))
                continue
            far = np.bitwise_count(points[own] ^ self.vantage[node]).astype(np.int16)
            todo.append((int(self.inner[node]), own[far <= self.cut[node]]))
            todo.append((int(self.outer[node]), own[far + radius > self.cut[node]]))
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int32), *leaves])


def build(sample: np.ndarray, leaf_points: int, radius: int) -> Tree:
    """Tree whose leaves hold at most about ``leaf_points`` of the sample, overlap included."""
    vantage: list[int] = []
    cut: list[int] = []
    inner: list[int] = []
    outer: list[int] = []
    leaves = 0

    todo: list[tuple[np.ndarray, list[int] | None, int]] = [(sample, None, 0)]
    while todo:
        points, side, parent = todo.pop()
        split = _split(points, radius) if len(points) > leaf_points else None
        if split is None:
            leaves += 1
            me = -leaves
        else:
            me = len(cut)
            v, c, near, far = split
            vantage.append(v)
            cut.append(c)
            inner.append(0)
            outer.append(0)
            todo += [(near, inner, me), (far, outer, me)]
        if side is not None:
            side[parent] = me
    return Tree(np.array(vantage, np.uint64), np.array(cut, np.int16), np.array(inner, np.int32), np.array(outer, np.int32), leaves)


def _split(points: np.ndarray, radius: int):
    """Vantage point, radius, inner and outer points of the best of a few vantage points.

    The best is the one whose branches hold the fewest pairs; none if no branch gets smaller.
    """
    best, found = 0.9 * len(points) ** 2, None
    for v in points[np.linspace(0, len(points) - 1, min(CANDIDATES, len(points))).astype(int)]:
        far = np.bitwise_count(points ^ v).astype(np.int64)
        at = np.cumsum(np.bincount(far, minlength=65 + radius))
        inside = at[:65].astype(np.float64)
        outside = len(points) - np.concatenate([np.zeros(radius), at])[:65].astype(np.float64)
        cost = np.where((inside > 0) & (outside > 0), inside**2 + outside**2, np.inf)
        c = int(cost.argmin())
        if cost[c] < best:
            best, found = float(cost[c]), (int(v), c, far)
    if found is None:
        return None
    v, c, far = found
    return v, c, points[far <= c], points[far + radius > c]


def links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join every group of distinct ``points`` within ``radius`` of one another, step by step.

    All pairs are compared where they meet, but only a star per group of
    each leaf is kept, so there are never more links than points in the leaves.
    """
    left, right = [], []
    for block in _blocks(points, radius):
        near = np.bitwise_count(block[:, None] ^ block[None, :]) <= radius
        if near.sum() == len(block):
            continue
        root = np.arange(len(block))
        while True:
            lower = np.where(near, root[None, :], len(block)).min(axis=1)
            lower = np.minimum(lower, lower[lower])
            if (lower == root).all():
                break
            root = lower
        own = np.flatnonzero(root != np.arange(len(block)))
        left.append(block[own])
        right.append(block[root[own]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _blocks(points: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Small sets of points in which every close pair meets; a set that no vantage point parts is tiled."""
    todo = [points]
    while todo:
        own = todo.pop()
        if len(own) <= BRUTE:
            if len(own) > 1:
                yield own
            continue
        split = _split(own, radius)
        if split is not None:
            todo += split[2:]
            continue
        half = BRUTE // 2
        tiles = [own[k : k + half] for k in range(0, len(own), half)]
        for i, a in enumerate(tiles):
            for b in tiles[i + 1 :] or [a[:0]]:
                yield np.concatenate([a, b])
