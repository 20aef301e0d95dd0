"""Cover tree of one block of vectors, and the search for inner products in it.

Vectors of different norms get one more component, the root of what their
squared norm lacks to the greatest of all. On that sphere the inner product
with a query falls as the distance grows, so a ball around a node's centre
bounds the inner products of everything below the node, from both sides.

Level by level a node's members are dealt to centres that are further than the
level's radius from each other; the node's own centre is the first of them, and
each member goes to the first centre within the radius. Radii halve at each
level. A node stores how far its members really reach, which is never more.
Groups of a few members, most of them without company, are points of their
parent: a node for them would cost more than it spares.

The search takes windows of inner products, and for each the first ``k`` points
by falling product, then by id. It goes best first by the bounds from above,
skips a node that lies outside all windows or below what they already have, and
works out the product of every point that it reaches exactly, in whole numbers.
"""

from __future__ import annotations

import heapq
import io
from typing import NamedTuple

import numpy as np

#: A node of so few members is a leaf, and a group of so few is no node of its own.
LEAF = 24
#: Points that are dealt at once.
BLOCK = 256
#: Id of points that have none; sorts last.
NO_ID = np.iinfo(np.int64).max


class Tree(NamedTuple):
    """Points in the order of the nodes that hold them; nodes in the order of levels."""

    points: np.ndarray  # n x dim
    ids: np.ndarray
    rows: np.ndarray  # what tells points with equal ids apart
    labels: np.ndarray
    center: np.ndarray  # node: index of a point
    radius: np.ndarray
    level: np.ndarray
    own: np.ndarray  # node: from where to where its points stand, n x 2
    below: np.ndarray  # node: from where to where its children stand, n x 2
    label_range: np.ndarray  # node: least and greatest label of all below, n x 2
    top: float  # greatest squared norm of all blocks

    def dump(self) -> bytes:
        out = io.BytesIO()
        small = [t for t in (np.int8, np.int16, np.int32) if not self.points.size or (np.abs(self.points).max() <= np.iinfo(t).max)]
        np.savez(out, **{k: v for k, v in self._asdict().items() if k != "points"}, points=self.points.astype(small[0] if small else np.int64))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as stored:
            parts = {k: stored[k] for k in cls._fields}
        exact = np.float64 if parts["top"] < 1 << 53 else np.int64
        return cls(**parts | {"points": parts["points"].astype(exact), "top": float(parts["top"])})


def lift(points: np.ndarray, top: float) -> np.ndarray:
    """Points on the sphere of squared radius ``top``, as floats."""
    points = points.astype(np.float64)
    lack = np.sqrt(np.maximum(0, top - np.einsum("ij,ij->i", points, points)))
    return np.concatenate([points, lack[:, None]], axis=1)


def distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    d = points - center
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def deal(sphere: np.ndarray, members: np.ndarray, radius: float, top: float) -> list[np.ndarray]:
    """Members by centres that are further than ``radius`` from each other, each group's centre first."""
    points = sphere[members]
    left = np.ones(len(members), dtype=bool)
    groups = []
    for start in range(0, len(members), BLOCK):
        # On the sphere, squared distances are what products lack to twice its squared radius.
        some = start + np.flatnonzero(left[start : start + BLOCK])
        near = 2 * top - 2 * (points[some] @ points[start:].T) <= radius * radius
        for c, close in zip(some, near):
            if left[c]:
                close[c - start] = True
                group = start + np.flatnonzero(close & left[start:])
                left[group] = False
                groups.append(members[group])
    return groups


def build(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, top: float) -> Tree:
    n = len(points)
    sphere = lift(points, top)
    root = int(distances(sphere, sphere.mean(axis=0)).argmin())

    def from_center(members: np.ndarray, center: int) -> tuple[np.ndarray, float]:
        away = distances(sphere[members], sphere[center])
        away[members == center] = -1  # comes first, even among equals
        order = np.argsort(away, kind="stable")
        return members[order], max(0.0, away[order[-1]])

    members, reach = from_center(np.arange(n), root)
    queue = [(members, reach, int(np.ceil(np.log2(max(reach, 1e-6)))))]
    nodes, place, at = [], [], 0
    for members, reach, level in queue:  # grows as nodes get children
        own, children = [members], []
        if len(members) > LEAF and reach > 0:
            while 2.0**level >= reach:
                level -= 1
            groups = deal(sphere, members, 2.0**level, top)
            own = [g for g in groups if len(g) <= LEAF]
            children = [(*from_center(g, g[0]), level - 1) for g in groups if len(g) > LEAF]
        held = np.concatenate(own) if own else members[:0]
        nodes.append((members[0], level, at, at + len(held), len(queue), len(queue) + len(children), labels[members].min(), labels[members].max(), reach))
        place.append(held)
        at += len(held)
        queue += children
    table = np.array([x[:-1] for x in nodes], dtype=np.int64)
    order = np.concatenate(place)
    new = np.empty(n, dtype=np.int64)
    new[order] = np.arange(n)
    return Tree(
        points[order], ids[order], rows[order], labels[order], new[table[:, 0]], np.array([x[-1] for x in nodes]), table[:, 1],
        table[:, 2:4], table[:, 4:6], table[:, 6:8], top,
    )


class Window:
    """The first ``k`` points of a range of inner products."""

    __slots__ = ("high", "least", "found", "k")

    def __init__(self, low: int, high: int, k: int):
        self.least, self.high, self.k = low, high, k
        self.found: list[tuple[int, int, int]] = []  # by falling product, then id and row

    def offer(self, products: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fit = np.flatnonzero((products >= self.least) & (products <= self.high))
        if len(fit) > self.k:  # ties of the last stay for their ids
            last = np.partition(products[fit], len(fit) - self.k)[len(fit) - self.k]
            fit = fit[products[fit] >= last]
        if len(fit):
            new = zip((-products[fit].astype(np.int64)).tolist(), ids[fit].tolist(), rows[fit].tolist())
            self.found = heapq.nsmallest(self.k, [*self.found, *new])
            if len(self.found) == self.k:
                self.least = max(self.least, -self.found[-1][0])


def bounds(products: np.ndarray, radius: np.ndarray, query_norm2: float, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product within a ball whose centre has the given one, with room for rounding."""
    away = np.sqrt(np.maximum(0, query_norm2 + top - 2 * products.astype(np.float64)))
    room = 1e-9 * (query_norm2 + top) + 1e-6
    far, near = away + radius, np.maximum(0, away - radius)
    return (query_norm2 + top - far * far) / 2 - room, (query_norm2 + top - near * near) / 2 + room


def search(tree: Tree, query: np.ndarray, label: int, same: bool, windows: list[Window], skip_row: int, at_root: np.ndarray | None = None) -> int:
    """Fill the windows with points of the query's label, or of others; the number of products worked out.

    ``at_root`` may hold the products of the root's own points, if they are known.
    """
    query = query.astype(tree.points.dtype)
    norm2 = float(query.astype(np.float64) @ query.astype(np.float64))
    ranges = tree.label_range
    may = (ranges[:, 0] <= label) & (label <= ranges[:, 1]) if same else (ranges[:, 0] != label) | (ranges[:, 1] != label)
    low, high = bounds(tree.points[tree.center[:1]] @ query, tree.radius[:1], norm2, tree.top)
    heap, used = [(-high[0], low[0], 0)] if may[0] else [], 1
    while heap:
        high, low, node = heapq.heappop(heap)
        if not any(-high >= w.least and low <= w.high and w.least <= w.high for w in windows):
            continue
        a, b = tree.own[node]
        if b > a:
            products = at_root if node == 0 and at_root is not None else tree.points[a:b] @ query
            used += b - a
            least, most = min(w.least for w in windows), max(w.high for w in windows)
            fit = np.flatnonzero((products >= least) & (products <= most))
            fit = fit[(tree.labels[a:b][fit] == label if same else tree.labels[a:b][fit] != label) & (tree.rows[a:b][fit] != skip_row)]
            if len(fit):
                products, ids, rows = products[fit], tree.ids[a:b][fit], tree.rows[a:b][fit]
                for w in windows:
                    w.offer(products, ids, rows)
        a, b = tree.below[node]
        if b > a:
            products = tree.points[tree.center[a:b]] @ query
            used += b - a
            lows, highs = bounds(products, tree.radius[a:b], norm2, tree.top)
            good = np.zeros(b - a, dtype=bool)
            for w in windows:
                if w.least <= w.high:
                    good |= (highs >= w.least) & (lows <= w.high)
            for i in np.flatnonzero(good & may[a:b]):
                heapq.heappush(heap, (-highs[i], lows[i], int(a + i)))
    return used


def search_all(tree: Tree, queries: np.ndarray, labels: list[int], same: bool, windows: list[list[Window]], skip_rows: list[int]) -> None:
    """``search`` for many queries; what all of them meet first, the root's own points, at once."""
    a, b = tree.own[0]
    for start in range(0, len(queries), 64):
        part = queries[start : start + 64].astype(tree.points.dtype)
        at_root = part @ tree.points[a:b].T
        for i, query in enumerate(part):
            search(tree, query, labels[start + i], same, windows[start + i], skip_rows[start + i], at_root[i])
