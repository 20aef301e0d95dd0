"""Centroids and hard negatives against brute force, on odd, repeated and clustered vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import centroids, cover_tree, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, row int"


def odd_rows(dim, n, seed=3):
    """Clusters of near copies, evenly spread vectors, equal ones, and all that takes no part."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dim)) / math.sqrt(dim)
    vecs = [base[rng.integers(6)] + rng.normal(size=dim) * (0.01 if i % 3 else 0.3) for i in range(n)]
    rows = [(i, [float(np.float32(x)) for x in v], int(rng.integers(4)), "c", 1) for i, v in enumerate(vecs)]
    rows += [(1000 + i, rows[5][1], i % 3, "c", 1) for i in range(40)]  # a third may be alike
    rows += [rows[7], rows[7], rows[0]]
    rows += [(None, rows[3][1], 1, None, None), (2000, None, 1, "c", 1), (2100, [0.0] * dim, None, "c", 1), (2200, [None] + [0.0] * (dim - 1), 1, "c", 1)]
    rows += [(2300, [float("nan")] * dim, 1, "c", 1), (2400, [float("inf")] + [0.0] * (dim - 1), 1, "c", 1), (2500, [], 1, "c", 1), (2600, [0.0] * dim, 2, "c", 1), (2700, [0.5] * (dim - 1), 2, "c", 1)]
    return rows


def whole(v, scale, dim=None):
    if v is None or (dim is not None and len(v) != dim) or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


# -- centroids ----------------------------------------------------------------


def lloyd(rows, k, rounds, dim, scale):
    kept = [(i, whole(v, scale, dim)) for i, v, *_ in rows if whole(v, scale, dim) is not None]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = np.array([v for _, v in order[:k]], dtype=object)
    vecs = np.array([v for _, v in kept], dtype=object)
    for i in range(rounds + 1):
        far = ((vecs[:, None] - now[None]) ** 2).sum(axis=2)
        place = far.astype(float).argmin(axis=1)
        if i < rounds:
            now = np.array([[int(s) // int((place == j).sum()) for s in vecs[place == j].sum(axis=0)] if (place == j).any() else now[j] for j in range(len(now))], dtype=object)
    return sorted((str(i), int(p), int(f[p])) for (i, _), p, f in zip(kept, place, far)), now.tolist()


@pytest.mark.parametrize("k,rounds", [(5, 4), (1, 2), (16, 0), (500, 2)])
def test_centroids_are_those_of_plain_rounds(spark, k, rounds):
    rows = odd_rows(8, 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out, final = centroids.cluster(df, k=k, rounds=rounds, dim=8, scale=64)
    expected, means = lloyd(rows, k, rounds, 8, 64)
    assert sorted((str(r.id), r.cluster, r.distance) for r in out.collect()) == expected
    assert final == means


def test_bounds_save_distances_and_hold_over_many_rounds(spark):
    rows = odd_rows(8, 400, seed=8)
    df = spark.createDataFrame(rows, SCHEMA)
    out, final = centroids.cluster(df, k=8, rounds=9, dim=8, scale=1000)
    expected, means = lloyd(rows, 8, 9, 8, 1000)
    assert sorted((str(r.id), r.cluster, r.distance) for r in out.collect()) == expected and final == means
    assert out.agg(F.avg("n_evaluated")).first()[0] < 0.5 * 8 * 10


def test_displacement_is_one_straight_line():
    """A centroid that went away and came back loosens nothing."""
    history = np.array([[[0, 0], [100, 0]], [[50, 0], [100, 0]], [[0, 0], [100, 0]]])
    vecs = np.array([[1, 0], [2, 3]])
    evaluated, at = np.zeros((2, 2), dtype=np.int64), np.full((2, 2), -1)
    first, used = centroids.reassign(vecs, np.array([-1, -1]), evaluated, at, history[:1])
    assert first.tolist() == [0, 0] and used.tolist() == [2, 2]
    again, used = centroids.reassign(vecs, first, evaluated, at, history)
    assert again.tolist() == [0, 0] and used.tolist() == [0, 0]


def test_no_vectors_no_clusters(spark):
    empty = spark.createDataFrame([(1, None, 1, "c", 1)], SCHEMA)
    out, final = centroids.cluster(empty, dim=8)
    assert out.collect() == [] and final == [] and centroids.with_inertia(out, final).collect() == []


# -- cover tree ---------------------------------------------------------------


def test_tree_covers_and_separates():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-50, 50, (200, 6)), rng.integers(-3, 3, (200, 6)), np.zeros((60, 6), dtype=int)])
    top = float((points**2).sum(axis=1).max())
    n = len(points)
    tree = cover_tree.Tree.load(cover_tree.build(points, np.arange(n), np.arange(n), np.zeros(n, dtype=int), top).dump())
    assert sorted(tree.ids.tolist()) == list(range(n))
    sphere = cover_tree.lift(tree.points, top)

    def members(node):
        out = list(range(*tree.own[node]))
        for child in range(*tree.below[node]):
            out += members(child)
        return out

    assert sorted(members(0)) == list(range(n))
    for node in range(len(tree.center)):
        held = members(node)
        assert tree.center[node] in held
        assert cover_tree.distances(sphere[held], sphere[tree.center[node]]).max() <= tree.radius[node] + 1e-9
        centers = [tree.center[c] for c in range(*tree.below[node])]
        for i, c in enumerate(centers):
            if len(centers) > 1:
                away = np.delete(cover_tree.distances(sphere[centers], sphere[c]), i)
                assert away.min() > max(tree.radius[x] for x in range(*tree.below[node])) / 2


def test_search_looks_at_few_points_of_a_clustered_block():
    rng = np.random.default_rng(6)
    points = np.floor(256 * np.repeat(rng.normal(size=(40, 16)) / 4, 50, axis=0) + rng.normal(size=(2000, 16))).astype(int)
    tree = cover_tree.Tree.load(cover_tree.build(points, np.arange(2000), np.arange(2000), np.zeros(2000, dtype=int), float((points**2).sum(axis=1).max())).dump())
    window = cover_tree.Window(-(1 << 62), 1 << 62, 5)
    used = cover_tree.search(tree, points[3], 0, True, [window], 3)
    scores = points @ points[3]
    assert window.found == sorted((-int(s), i, i) for i, s in enumerate(scores) if i != 3)[:5]
    assert used < 400


# -- hard negatives -----------------------------------------------------------


def brute(rows, n_pos, n_neg, low, high, scale, every):
    dim = max(len(v) for _, v, *_ in rows if v is not None)
    kept = [(i, lab, (w + [0] * dim)[:dim]) for i, v, lab, *_ in rows if lab is not None and (w := whole(v, scale)) is not None]
    out = []
    for a, (i, lab, v) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, b, other) for b, (j, other, w) in enumerate(kept) if b != a)
        name = lambda s: None if s[1] else s[2]
        for p in [s for s in scored if s[4] == lab][:n_pos]:
            fit = [s for s in scored if s[4] != lab and low * -p[0] <= 100 * -s[0] <= high * -p[0]]
            out += [(i, name(p), rank, name(s), -p[0], -s[0]) for rank, s in enumerate(fit[:n_neg], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("tile_rows,scale", [(16, 256), (4096, 256), (60, 3e6)])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, tile_rows, scale):
    monkeypatch.setattr(hard_negatives, "CHUNK", 7)
    monkeypatch.setattr(hard_negatives, "MAX_CELLS", 5)
    rows = odd_rows(9, 160)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), 3, 4, 30, 90, scale, tile_rows)
    # Rows of one id that stand in each other's ties differ by nothing that is returned.
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 3, 4, 30, 90, scale, 10)


def test_no_anchors_no_negatives(spark):
    df = spark.createDataFrame(odd_rows(4, 12), SCHEMA)
    for rows in (df.limit(0), df.filter("vec_id = 3"), df.filter("vec_id = 2000")):
        assert hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, F.col("label")).collect() == []
    alone = hard_negatives.mine(df.filter("vec_id = 0").limit(1), F.col("vec_id") % 100 == 0, F.col("label"))
    assert alone.collect() == []
