"""Nearest vectors and all near ones, without comparing everything: blocks of
references around pivots, left out by the triangle inequality.

Similarity is the dot product. References get one more component, the root of
what their squared length lacks to the greatest of all: a query's similarity
then falls as its distance grows, unit vectors or not. Every reference belongs to its nearest pivot, and the pivot
knows how far its own reach; what lies further off than that from a query's best
so far, or from its threshold, is not looked at. Similarities that decide are
summed exactly, so equal vectors tie whatever their place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Rounding that bounds allow for, in distances of vectors whose length is about one.
ROOM = 1e-6
#: Numbers that are held at once where sums run in order.
PRODUCTS = 1 << 21


def exact(a: np.ndarray, b: np.ndarray) -> float:
    """Dot product, rounded once."""
    return math.fsum((a * b).tolist())


class Blocks:
    """References by pivots. ``compared`` counts the products that were worked out."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.asarray(vectors, dtype=np.float64)
        self.compared = 0
        lengths = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.top = float(lengths.max())
        lifted = np.concatenate([self.vectors, np.sqrt(self.top - lengths)[:, None]], axis=1)
        n = len(lifted)
        k = max(1, int(math.sqrt(n)))
        chosen = [0]
        away = self._away(lifted, lifted[0])
        owner = np.zeros(n, dtype=np.int64)
        while len(chosen) < k and away.max() > ROOM:  # each pivot the furthest from those before
            chosen.append(int(away.argmax()))
            new = self._away(lifted, lifted[chosen[-1]])
            owner[new < away] = len(chosen) - 1
            away = np.minimum(away, new)
        self.pivots = lifted[chosen]
        self.order = np.argsort(owner, kind="stable")
        self.ends = np.searchsorted(owner[self.order], np.arange(len(chosen) + 1))
        self.sorted = lifted[self.order]
        # A pivot whose equals came before it has none of its own.
        self.reach = np.array([away[self.order[a:b]].max() if b > a else 0.0 for a, b in zip(self.ends, self.ends[1:])])

    @staticmethod
    def _away(points: np.ndarray, center: np.ndarray) -> np.ndarray:
        d = points - center
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _block(self, query: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances of a block's references, and which they are."""
        a, b = self.ends[block], self.ends[block + 1]
        self.compared += b - a
        return self._away(self.sorted[a:b], query), self.order[a:b]

    def _from(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The query, lifted too, and how near each block's references can be."""
        query = np.asarray(query, dtype=np.float64)
        lifted = np.append(query, 0.0)
        self.compared += len(self.pivots)
        return query, lifted, self._away(self.pivots, lifted) - self.reach

    def within(self, query: np.ndarray, similarity: float) -> Iterator[tuple[int, float]]:
        """(reference, similarity) of at least this similarity."""
        query, lifted, least = self._from(query)
        limit = math.sqrt(max(0.0, float(query @ query) + self.top - 2 * similarity)) + ROOM
        for block in np.flatnonzero(least <= limit):
            away, which = self._block(lifted, int(block))
            for r in which[away <= limit]:
                s = exact(query, self.vectors[r])
                if s >= similarity:
                    yield int(r), s

    def nearest(self, query: np.ndarray) -> list[tuple[int, float]]:
        """(reference, similarity) of the most similar ones: several if they tie."""
        query, lifted, least = self._from(query)
        best, near = math.inf, []
        for block in np.argsort(least, kind="stable"):
            if least[block] > best + ROOM:
                break
            away, which = self._block(lifted, int(block))
            if len(away):
                best = min(best, away.min())
                near += [(d, r) for d, r in zip(away.tolist(), which.tolist()) if d <= best + ROOM]
        some = [(r, exact(query, self.vectors[r])) for d, r in near if d <= best + ROOM]
        top = max(s for _, s in some)
        return [(r, s) for r, s in some if s == top]


def nearest_in_rows(queries: pa.Array, known: pa.Array, draw: Callable[[list[str]], np.ndarray] | None = None) -> pa.Array:
    """Of each row's query vectors, the place of the most similar one of the row's known vectors, the first
    of equals, and the similarity, which is -inf if there is none. Vectors are of one size; sums run in order.
    With ``draw``, rows hold texts, whose vectors it makes, once for each text of the batch. Rows that have
    as many vectors each are compared together."""

    def flat(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different vectors as columns, which of them each item has, and where rows begin and end."""
        own, ends = rows.flatten(), np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        if not len(own):
            vectors, which = np.empty((0, 0)), np.empty(0, dtype=np.int64)
        elif draw:
            texts = own.dictionary_encode()
            vectors, which = np.asarray(draw(texts.dictionary.to_pylist()), dtype=np.float64), texts.indices.to_numpy(zero_copy_only=False)
        else:
            vectors, which = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1), np.arange(len(own))
        return np.ascontiguousarray(vectors.T), which, ends.astype(np.int32)

    (q, q_of, at), (k, k_of, to) = flat(queries), flat(known)
    place, best = np.zeros(len(q_of), dtype=np.int32), np.full(len(q_of), -np.inf)
    shapes, shape_of = np.unique(np.stack([np.diff(at), np.diff(to)]), axis=1, return_inverse=True)
    shape_of = shape_of.reshape(-1)
    by_shape = np.split(np.argsort(shape_of, kind="stable"), np.cumsum(np.bincount(shape_of, minlength=shapes.shape[1]))[:-1])
    for (n, m), alike in zip(shapes.T.tolist(), by_shape):
        if n and m:
            # Rows at once, and of each row some queries, if it is that large.
            step = max(1, PRODUCTS // (n * m + len(k) * (n + m)))
            part = max(1, min(n, PRODUCTS // (m + len(k))))
            for some in (alike[i : i + step] for i in range(0, len(alike), step)):
                theirs = k[:, k_of[to[some] + np.arange(m)[:, None]]]
                for first in range(0, n, part):
                    items = at[some] + np.arange(first, min(n, first + part))[:, None]
                    own, sims = q[:, q_of[items]], np.zeros((len(items), m, len(some)))
                    for x, y in zip(own, theirs):
                        sims += x[:, None, :] * y
                    top = sims.argmax(axis=1)
                    place[items], best[items] = top, np.take_along_axis(sims, top[:, None, :], axis=1)[:, 0, :]
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(place), pa.array(best)], ["i", "sim"]))
