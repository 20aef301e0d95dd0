"""Hard negatives: for an anchor and each of its positives, the most similar
vectors of other labels within a window around the positive's score.

Scores are inner products of whole numbers. Candidates are dealt to cells by
the nearest of some pivots, and each cell to tiles of about ``tile_rows`` rows,
however many of all rows one cell holds; a tile's cover tree is built once and
stored. Anchors go to tiles in chunks, and a tile and a chunk meet in one group
of bounded size. Three visits:

1. an anchor's own tile, for a first bound of its positives;
2. all other tiles whose cell's ball may hold a better one: with these, the
   positives are exact;
3. all tiles whose cell's ball meets a window: the negatives.

What tiles found is merged by rank, of which Spark keeps the first rows of each
task before it shuffles. Scores are exact; bounds only tell where not to look.
Where vectors spread evenly over all directions, no exact method can skip much,
and the third visit is anchors times tiles, in products of vectors and blocks.

Pivots are fitted to the ``SAMPLE`` rows of the least hashes: they are at most
``MAX_CELLS``, and only decide which rows lie together. Every row is in a tile.

Nulls and odd input: rows with a null label, a null vector, or a null or
non-finite component take no part; a null id is nobody's anchor and sorts last.
Shorter vectors count as ending in zeros. Rows are told apart even when their
ids repeat. An empty table, or one without anchors, gives no rows; a positive
with a score below zero has an empty window. A scaled component of 2**27 or
more is an error. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import cover_tree
from plumbline.llm.common import written
from plumbline.llm.vectors import matrix, scaled

#: Rows that pivots are fitted to.
SAMPLE = 2048
#: Cells at most; what they hold beyond a tile's rows is split further.
MAX_CELLS = 256
#: Anchors of a chunk.
CHUNK = 8192

PLACED = "row bigint, id bigint, label bigint, anchor boolean, vec array<int>, cell int, away double"
FOUND = "row bigint, place int, score bigint, id bigint, other bigint"


class Index(NamedTuple):
    """Candidates in cells and tiles, and their trees."""

    placed: DataFrame
    trees: DataFrame  # cell, sub, tree
    pivots: np.ndarray  # on the sphere
    reach: np.ndarray  # cell: its ball's radius
    subs: np.ndarray  # cell: number of its tiles
    top: float
    dim: int
    parts: int  # chunks of anchors


def candidates(vectors: DataFrame, label: Column, anchor: Column, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part: id, label, whether an anchor, integer components, squared norm."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, lengths, values = scaled(batch.column("vec"), scale)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            norms = np.bincount(np.repeat(np.arange(len(good)), lengths), weights=values.astype(np.float64) ** 2, minlength=len(good))
            vecs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            kept = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("id", "label", "anchor")), vecs, pa.array(norms, pa.float64())], ["id", "label", "anchor", "vec", "norm2"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.filter("label IS NOT NULL").mapInArrow(cut, "id bigint, label bigint, anchor boolean, vec array<int>, norm2 double")


def spread_out(points: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` of the points, each the furthest from those before."""
    chosen = [0]
    away = cover_tree.distances(points, points[0])
    while len(chosen) < k and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, cover_tree.distances(points, points[chosen[-1]]))
    return points[chosen]


def build_index(rows: DataFrame, tile_rows: int) -> Index | None:
    rows = written(rows, "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max("norm2").alias("top"), F.max(F.size("vec")).alias("dim"), F.count_if("anchor").alias("anchors")).first()
    if not facts.anchors:
        return None
    dim, top = max(1, facts.dim), float(facts.top) + 1
    sample = rows.orderBy(F.xxhash64("id", "vec"), "id", "vec").limit(SAMPLE).select("vec").toArrow().column("vec")
    pivots = spread_out(cover_tree.lift(matrix(sample, dim), top), min(MAX_CELLS, -(-facts.n // tile_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (pivots**2).sum(axis=1)
        for batch in batches:
            lifted = cover_tree.lift(matrix(batch.column("vec"), dim), top)
            cell = (weights - 2 * lifted @ pivots.T).argmin(axis=1)
            away = cover_tree.distances(lifted, pivots[cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], [*batch.schema.names, "cell", "away"])

    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", "vec")
    placed = written(keyed.mapInArrow(place, PLACED), "cells")
    reach, subs = np.zeros(len(pivots)), np.ones(len(pivots), dtype=np.int64)
    for r in placed.groupBy("cell").agg(F.max("away").alias("reach"), F.count("*").alias("n")).collect():  # MAX_CELLS rows at most
        reach[r.cell], subs[r.cell] = r.reach, -(-r.n // tile_rows)

    def plant(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        ids = block.column("id").fill_null(cover_tree.NO_ID).to_numpy()
        tree = cover_tree.build(matrix(block.column("vec"), dim), ids, block.column("row").to_numpy(), block.column("label").to_numpy(), top)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "sub": pa.array([key[1].as_py()], pa.int64()), "tree": pa.array([tree.dump()], pa.binary())})

    counts = F.array(*(F.lit(int(n)) for n in subs))
    tiles = placed.withColumn("sub", _sub(F.col("row"), F.get(counts, F.col("cell"))))
    trees = written(tiles.groupBy("cell", "sub").applyInArrow(plant, "cell int, sub bigint, tree binary"), "trees")
    return Index(placed, trees, pivots, reach, subs, top, dim, -(-facts.anchors // CHUNK))


def _sub(row: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(row), n.cast("bigint"))


def _hundredths(x: Column) -> Column:
    """floor(x / 100) of whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def visit(index: Index, requests: DataFrame, same: bool, k: int, route: str) -> DataFrame:
    """What the tiles hold for the requests: ``row, id, label, vec, sub, low, high``, the last two
    arrays of a bound for each window. ``route`` is ``own`` (the anchor's tile), ``others`` or ``all``.

    Returns the request's ``row``, the window's ``place``, and the ``score``, ``id`` and row (``other``) of points.
    """
    pivots, reach, subs, top, dim = index.pivots, index.reach, index.subs, index.top, index.dim
    fields = "cell int, tile bigint, part bigint, row bigint, label bigint, vec array<int>, low array<bigint>, high array<bigint>"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.concatenate([[0], np.cumsum(subs)])
        cell_of = np.repeat(np.arange(len(subs)), subs)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                vecs = matrix(batch.column("vec"), dim, np.float64)
                cell, sub = batch.column("cell").to_numpy(), batch.column("sub").to_numpy()
                own = first[cell] + sub
                if route == "own":
                    who, tile = np.arange(len(own)), own
                else:
                    norm2 = np.einsum("ij,ij->i", vecs, vecs)
                    meets = np.zeros((len(own), len(subs)), dtype=bool)
                    products = vecs @ pivots[:, :-1].T  # a query has nothing in the last component
                    for i in range(len(own)):
                        low, high = cover_tree.bounds(products[i], reach, norm2[i], top)
                        for a, b in zip(batch.column("low")[i].as_py(), batch.column("high")[i].as_py()):
                            meets[i] |= (high >= a) & (low <= b) & (a <= b)
                    spread = meets[:, cell_of]
                    if route == "others":
                        spread[np.arange(len(own)), own] = False
                    who, tile = np.nonzero(spread)
                for a in range(0, len(who), 4096):
                    taken = batch.take(pa.array(who[a : a + 4096]))
                    to = tile[a : a + 4096]
                    columns = [pa.array(cell_of[to], pa.int32()), pa.array(to - first[cell_of[to]], pa.int64()), *(taken.column(c) for c in ("part", "row", "label", "vec", "low", "high"))]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "tile", "part", "row", "label", "vec", "low", "high"])

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        if asked.num_rows and held.num_rows:
            tree = cover_tree.Tree.load(held.column("tree")[0].as_py())
            rows, labels, lows, highs = (asked.column(c).to_pylist() for c in ("row", "label", "low", "high"))
            windows = [[cover_tree.Window(*ends, k) for ends in zip(*both)] for both in zip(lows, highs)]
            cover_tree.search_all(tree, matrix(asked.column("vec"), dim), labels, same, windows, rows)
            for row, own in zip(rows, windows):
                out += [(row, place, -score, None if at == cover_tree.NO_ID else at, other) for place, w in enumerate(own) for score, at, other in w.found]
        columns = list(zip(*out)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["row", "place", "score", "id", "other"])

    asked = requests.withColumn("part", _sub(F.col("row") + 1, F.lit(index.parts))).select("cell", "sub", "part", "row", "label", "vec", "low", "high").mapInArrow(send, fields)
    held = index.trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(index.parts - 1)))).select("cell", F.col("sub").alias("tile"), F.col("part").cast("bigint").alias("part"), "tree")
    return asked.groupBy("cell", "tile", "part").cogroup(held.groupBy("cell", "tile", "part")).applyInArrow(meet, FOUND)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each request's window, with their ``rank``."""
    order = Window.partitionBy("row", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
    scale: float = 256, tile_rows: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Negatives of each anchor and positive, of scores from ``low`` to ``high`` hundredths of the positive's."""
    spark = vectors.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    index = build_index(candidates(vectors, label, anchor, scale, id_col, vec_col), tile_rows)
    if index is None:
        return spark.createDataFrame([], schema)
    least, most = (F.lit(x).cast("bigint") for x in (-(1 << 62), 1 << 62))
    counts = F.array(*(F.lit(int(n)) for n in index.subs))
    anchors = index.placed.filter("anchor").withColumn("sub", _sub(F.col("row"), F.get(counts, F.col("cell"))))
    near = written(visit(index, anchors.withColumns({"low": F.array(least), "high": F.array(most)}), True, n_positives, "own"), "near")
    bound = near.groupBy("row").agg(F.when(F.count("*") >= n_positives, F.min("score")).otherwise(least).alias("bound"))
    others = anchors.join(bound, "row", "left").withColumns({"low": F.array(F.coalesce("bound", least)), "high": F.array(most)})
    far = visit(index, others, True, n_positives, "others")
    positives = written(first_of(near.unionByName(far), n_positives).select("row", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Windows stand in the order of their positives.
    score = F.col("positive_score")
    ends = F.array_sort(F.collect_list(F.struct("place", (-_hundredths(-score * low)).alias("low"), _hundredths(score * high).alias("high"))))
    windows = positives.groupBy("row").agg(ends.alias("ends")).select("row", F.col("ends.low").alias("low"), F.col("ends.high").alias("high"))
    found = first_of(visit(index, anchors.join(windows, "row"), False, n_negatives, "all"), n_negatives)
    named = found.join(positives, ["row", "place"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
