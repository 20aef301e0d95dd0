"""Connected components of an edge table, by label propagation in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node of ``edges`` (a, b); the root is the
    component's smallest node.

    Each round a node takes the smallest label among its neighbours and then
    its label's label, so the rounds grow with the logarithm of a path's
    length. Minima combine on the map side, so a node with many neighbours
    costs no more than its edges. Rounds are written to the shared store;
    only the number of changed labels comes to the driver. Edges may repeat,
    run both ways or join a node to itself; null ends are skipped.
    """
    pairs = edges.select("a", "b").filter("a is not null and b is not null")
    both = written(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        own = labels.select("node", F.col("root").alias("own"))
        step = own.join(near, "node").select("node", "own", F.least("own", "near").alias("root"))
        hop = own.select(F.col("node").alias("root"), F.col("own").alias("beyond"))
        new = written(step.join(hop, "root").select("node", F.least("root", "beyond").alias("root"), (F.least("root", "beyond") != F.col("own")).alias("changed")), "labels")
        labels = new.select("node", "root")
        if new.filter("changed").isEmpty():
            return labels
