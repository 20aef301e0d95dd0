"""Centroid clustering in exact integers, with ns-bounds.

Lloyd's rounds keep for every vector and centroid the squared distance as it
was last worked out, and the round in which that was. The driver keeps the
history of all centroids: a few numbers for each round. A stored distance is
loosened by the norm of the *total* displacement of its centroid since its
round, the length of one straight line, and not by the sum of the drifts of the
rounds in between, which is never less. If the own centroid's bound from above
is below the bounds from below of all others, the vector stays, and nothing is
worked out. Else the own distance is renewed, and after it those of the
centroids that still come near; they are whole numbers, so ties are exact.

Each round is one pass of NumPy over Arrow batches that writes the state to the
shared store; a lost executor costs the portions it was at. Sums change by the
vectors that moved: each task adds those up for itself, and Spark adds up the
tasks' rows, one for each centroid. What reaches the driver is ``k`` sums.

Nulls and odd input: vectors that are null, have another number of components
than ``dim``, or a null or non-finite one are left out. The first centroids are
the vectors whose ids' hashes are smallest (null ids last, repeated ids by their
vectors); fewer vectors than ``k`` give as many centroids, and none an empty
result. Centroids of the same place are told by their number: the smaller takes
all, and one left without vectors stays where it is. Repeated rows are clustered
each. A scaled component of 2**27 or more is an error. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.vectors import lists, matrix, scaled

STATE = "id {id}, vec array<int>, was int, cluster int, evaluated array<bigint>, at array<tinyint>, n_evaluated bigint"


def whole_vectors(vectors: DataFrame, dim: int, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """Id and integer components (``vec``) of the vectors that take part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = batch.filter(pa.compute.equal(batch.column(1).value_lengths(), dim).fill_null(False))
            good, _, values = scaled(full.column(1), scale)
            yield pa.RecordBatch.from_arrays([full.column(0).take(pa.array(good)), lists(values.reshape(len(good), dim), pa.int32())], ["id", "vec"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, vec array<int>")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def reassign(vecs: np.ndarray, cluster: np.ndarray, evaluated: np.ndarray, at: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of ``history[-1]`` for each vector, and how many distances that took.

    ``evaluated`` (squared distances) and ``at`` (their rounds, below 0: never)
    are brought up to date in place.
    """
    now, last = history[-1], len(history) - 1
    n, k = evaluated.shape
    rows = np.arange(n)
    moved = np.sqrt(((history - now) ** 2).sum(axis=2).astype(np.float64))  # by round and centroid
    stored, loose = np.sqrt(evaluated.astype(np.float64)), moved[at, np.arange(k)]
    lower = np.where(at < 0, -np.inf, stored - loose)
    own = np.maximum(cluster, 0)
    upper = np.where(at[rows, own] < 0, np.inf, (stored + loose)[rows, own])
    lower[rows, own] = np.inf
    margin = 1e-9 * (1 + upper)  # far above what square roots round, and nothing against whole numbers
    unsure = np.flatnonzero(~(lower.min(axis=1) > upper + margin))
    used = np.zeros(n, dtype=np.int64)
    evaluated[unsure, own[unsure]] = squared(vecs[unsure], now[own[unsure]])
    at[unsure, own[unsure]] = last
    used[unsure] = 1
    upper = np.sqrt(evaluated[unsure, own[unsure]].astype(np.float64))
    near = ~(lower[unsure] > (upper + 1e-9 * (1 + upper))[:, None])
    for j in range(k):
        scan = unsure[near[:, j]]
        evaluated[scan, j] = squared(vecs[scan], now[j])
        at[scan, j] = last
        used[scan] += 1
    # All that are not of this round are further off than the own centroid.
    fresh = np.where(at[unsure] == last, evaluated[unsure], np.iinfo(np.int64).max)
    out = own.copy()
    out[unsure] = fresh.argmin(axis=1)
    return out, used


def _round(rows: DataFrame, history: np.ndarray, dim: int, first: bool) -> DataFrame:
    k = history.shape[1]
    schema = STATE.format(id=rows.schema["id"].dataType.simpleString())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vecs = matrix(batch.column("vec"), dim)
            if first:
                was, evaluated, at, used = np.full(n, -1), np.zeros((n, k), dtype=np.int64), np.full((n, k), -1), 0
            else:
                was, used = batch.column("cluster").to_numpy(), batch.column("n_evaluated").to_numpy()
                evaluated, at = matrix(batch.column("evaluated"), k), matrix(batch.column("at"), k)
            cluster, n_evaluated = reassign(vecs, was, evaluated, at, history)
            columns = [batch.column("id"), batch.column("vec"), pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), lists(evaluated, pa.int64()), lists(at, pa.int8()), pa.array(used + n_evaluated, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vec", "was", "cluster", "evaluated", "at", "n_evaluated"])

    return rows.mapInArrow(step, schema)


def _changes(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much this round changed each centroid's number of vectors and their sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            vecs = matrix(batch.column("vec"), dim)
            for column, sign in (("cluster", 1), ("was", -1)):
                place = batch.column(column).to_numpy()
                for j in np.unique(place[place >= 0]):
                    own = place == j
                    n[j] += sign * own.sum()
                    sums[j] += sign * vecs[own].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(n), lists(sums, pa.int64())], ["cluster", "n", "sums"])

    parts = state.filter("was <> cluster").select("vec", "was", "cluster").mapInArrow(add, "cluster int, n bigint, sums array<bigint>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums"))
    n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
    for r in total.collect():
        n[r.cluster], sums[r.cluster] = r.n, r.sums
    return n, sums


def seed_order(id_col: Column) -> Column:
    """The order in which vectors are taken as first centroids."""
    return F.sha2(F.concat(F.lit("1:"), id_col.cast("string")), 256).asc_nulls_last()


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64, id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """Cluster of each vector that takes part, and the centroids.

    The table has ``id``, ``vec`` (scaled components), ``cluster``, ``distance``
    (squared) and ``n_evaluated``, the distances that were worked out for the vector.
    """
    rows = whole_vectors(vectors, dim, scale, id_col, vec_col)
    seeds = rows.orderBy(seed_order(F.col("id")), "vec").limit(k).collect()
    history = np.array([s.vec for s in seeds], dtype=np.int64).reshape(1, len(seeds), dim)
    k = len(seeds)
    if k == 0:
        return rows.select("id", "vec", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(0).cast("bigint").alias("n_evaluated")), []
    n, sums, state = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64), rows
    for i in range(rounds):
        state = written(_round(state, history, dim, first=i == 0), "clusters")
        n_more, more = _changes(state, k, dim)
        n, sums = n + n_more, sums + more
        means = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], history[-1])
        history = np.concatenate([history, means[None]])
    state = written(_round(state, history, dim, first=rounds == 0), "clusters")
    now = history[-1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("cluster").to_numpy()
            far = squared(matrix(batch.column("vec"), dim), now[place])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "vec", "cluster")), pa.array(far, pa.int64()), batch.column("n_evaluated")], ["id", "vec", "cluster", "distance", "n_evaluated"])

    kind = rows.schema["id"].dataType.simpleString()
    out = state.select("id", "vec", "cluster", "n_evaluated").mapInArrow(measure, f"id {kind}, vec array<int>, cluster int, distance bigint, n_evaluated bigint")
    return out, now.tolist()


def digest(centroid: list[int]) -> str:
    """SHA-256 of a centroid's components, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Clustered rows with the inertia of their cluster and of all, and their centroid's digest."""
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    total = sum(sums.values())
    table = rows.sparkSession.createDataFrame(
        [(j, s, total, digest(centroids[j])) for j, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    return rows.join(F.broadcast(table), "cluster")
