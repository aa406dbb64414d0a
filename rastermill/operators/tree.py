"""Exact nearest neighbours among points in arrays, for many queries at once."""

from __future__ import annotations

import numpy as np

#: Squared bounds are widened by this factor, so that rounding never loses a neighbour.
SLACK = 1 + 1e-9


def along(x: np.ndarray, y: np.ndarray, x0: float, x1: float, y0: float, y1: float, bits: int = 16) -> np.ndarray:
    """Places on a Hilbert curve over the box."""
    top = (1 << bits) - 1
    u, v = (((c - lo) / (hi - lo or 1.0) * top).astype(np.int64) for c, lo, hi in ((x, x0, x1), (y, y0, y1)))
    at, s = np.zeros(len(u), np.int64), 1 << (bits - 1)
    while s:
        rx, ry = (u & s) > 0, (v & s) > 0
        at += s * s * ((3 * rx) ^ ry)
        turn = rx & ~ry
        u, v = np.where(turn, top - u, u), np.where(turn, top - v, v)
        u, v = np.where(ry, u, v), np.where(ry, v, u)
        s >>= 1
    return at


def gap2(boxes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances to boxes (..., 4) of x0, x1, y0, y1; 0 inside."""
    dx = np.maximum(np.maximum(boxes[..., 0] - x, x - boxes[..., 1]), 0)
    dy = np.maximum(np.maximum(boxes[..., 2] - y, y - boxes[..., 3]), 0)
    return dx * dx + dy * dy


def _place(*keys: np.ndarray) -> np.ndarray:
    """Each row's place within its run of equal keys, from 0 on."""
    at = np.arange(len(keys[0]))
    new = np.ones(len(at), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return at - np.maximum.accumulate(np.where(new, at, 0))


class Tree:
    """Points packed along a Hilbert curve into leaves, FAN leaves or boxes under a box. A point's rank is its row, by which ties go.

    Of each position only the first k rows are kept, since no other can be among the k nearest.
    """

    LEAF, FAN = 16, 8
    MOST = LEAF // 2  # the largest k

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int = 1):
        order = np.lexsort((np.arange(len(x)), y, x))
        rank = order[_place(x[order], y[order]) < k] if len(x) else order
        x, y = x[rank], y[rank]
        self.levels: list[np.ndarray] = []
        if not len(x):
            return
        self.box = x.min(), x.max(), y.min(), y.max()
        curve = along(x, y, *self.box)
        o = np.argsort(curve, kind="stable")
        n = -(-len(o) // self.LEAF)
        leaf = np.arange(len(o)) * n // len(o)  # evenly, so that every leaf is half full at least and bounds k distances
        self.points, self.rank = np.full((n, self.LEAF, 2), np.inf), np.full((n, self.LEAF), -1)
        self.points[leaf, _place(leaf)], self.rank[leaf, _place(leaf)] = np.stack([x[o], y[o]], axis=-1), rank[o]
        self.firsts = curve[o][np.searchsorted(leaf, np.arange(n))]
        real = np.where(np.isinf(self.points), -np.inf, self.points)
        boxes = np.stack([f(v[..., c], axis=1) for c in (0, 1) for f, v in ((np.min, self.points), (np.max, real))], axis=-1)
        empty = np.array([np.inf, -np.inf, np.inf, -np.inf])
        while True:
            boxes = np.concatenate([boxes, np.tile(empty, (-len(boxes) % self.FAN, 1))]).reshape(-1, self.FAN, 4)
            self.levels.insert(0, boxes)
            if len(boxes) == 1:
                return
            boxes = np.stack([f(boxes[..., c], axis=1) for c, f in enumerate((np.min, np.max, np.min, np.max))], axis=-1)

    def query(self, x: np.ndarray, y: np.ndarray, k: int = 1, within: float = np.inf, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, rank, distance, place) of up to k nearest points by (distance, rank), within the distance, inclusive; NaN finds none."""
        with np.errstate(invalid="ignore", over="ignore"):
            found = [self._block(x[i : i + block], y[i : i + block], k, within, i) for i in range(0, len(x), block)] if self.levels else []
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        return tuple(np.concatenate(v) for v in zip(*found, strict=True))

    def _block(self, x, y, k, within, start):
        at = np.zeros(len(x), np.int64)
        for boxes in self.levels:  # straight down to one leaf
            at = at * self.FAN + gap2(boxes[at], x[:, None], y[:, None]).argmin(1)
        x0, x1, y0, y1 = self.box
        on = along(np.clip(np.nan_to_num(x), x0, x1), np.clip(np.nan_to_num(y), y0, y1), *self.box)
        # the k-th points of this leaf and of the one at the query's place on the curve bound the distance; boxes without points are infinitely far
        bound = np.minimum(within * within * SLACK, np.finfo(float).max)
        for leaf in (at, np.maximum(np.searchsorted(self.firsts, on, side="right") - 1, 0)):
            d = self.points[leaf] - np.stack([x, y], axis=-1)[:, None]
            bound = np.minimum(bound, np.partition((d * d).sum(-1), k - 1, axis=1)[:, k - 1] * SLACK)
        i, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        for boxes in self.levels:
            row, child = np.nonzero(gap2(boxes[at], x[i, None], y[i, None]) <= bound[i, None])
            i, at = i[row], at[row] * self.FAN + child
        dx, dy = x[i, None] - self.points[at, :, 0], y[i, None] - self.points[at, :, 1]
        d2 = dx * dx + dy * dy
        row, slot = np.nonzero((d2 <= bound[i, None]) & (self.rank[at] >= 0))
        i, rank, d = i[row], self.rank[at[row], slot], np.sqrt(d2[row, slot])
        order = np.lexsort((rank, d, i))
        order = order[d[order] <= within]
        i, rank, d = i[order], rank[order], d[order]
        place = _place(i) if len(i) else i
        best = place < k
        return i[best] + start, rank[best], d[best], place[best] + 1
