"""Names and references of a source brought together, in tiles of a bounded size.

A source's names are dealt to rows of tiles and its references to columns, by a
hash of their text: most sources are one tile, and one that holds a third of
everything is as many as its size asks for. A tile's names and references pass
through one task as a stream, in one exchange, without a call for each source.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.store import written

#: Names, and references, of a tile; a tile has about as many.
TILE_ROWS = 20_000


def dealt(names: DataFrame, refs: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(source_id, i, j, is_ref, text, ..) of both tables (source_id, text, ..), whose tiles are whole in
    one partition and stand together, references first. Rows without a source meet nothing and are left out."""
    both = names.withColumn("is_ref", F.lit(False)).unionByName(refs.withColumn("is_ref", F.lit(True)))
    both = written(both.filter("source_id IS NOT NULL"), "tiles")
    sizes = both.groupBy("source_id").agg(*(F.ceil(F.count_if(c) / tile_rows).cast("int").alias(n) for n, c in (("rows", ~F.col("is_ref")), ("columns", F.col("is_ref")))))
    large = sizes.filter("rows > 1 OR columns > 1")
    # There are fewer of them than rows by the size of a tile.
    sized = both.join(F.broadcast(large), "source_id", "left").fillna(1, ["rows", "columns"])
    own = F.pmod(F.xxhash64("text"), F.when(F.col("is_ref"), F.col("columns")).otherwise(F.col("rows")).cast("bigint")).cast("int")
    other = F.when(F.col("is_ref"), F.col("rows")).otherwise(F.col("columns"))
    each = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(other, F.lit(1)) - 1)))
    placed = each.withColumns({"i": F.when(F.col("is_ref"), F.col("other")).otherwise(F.col("own")), "j": F.when(F.col("is_ref"), F.col("own")).otherwise(F.col("other"))})
    extra = [c for c in names.columns if c not in ("source_id", "text")]
    keys = ["source_id", "i", "j"]
    return placed.select(*keys, "is_ref", "text", *extra).repartition(*keys).sortWithinPartitions(*keys, F.desc("is_ref"))


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], list[str]]]:
    """(source_id, names, references) of each tile of such a stream that has both: their texts, each once."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("source_id", "i", "j", "is_ref", "text"))))
    for (source, _, _), tile in groupby(rows, itemgetter(0, 1, 2)):
        sides: tuple[dict[str, None], dict[str, None]] = ({}, {})
        for *_, is_ref, text in tile:
            sides[is_ref][text] = None
        if all(sides):
            yield source, *map(list, sides)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows of any number of tiles as batches of a bounded size."""
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table, pa.Table]]:
    """(source_id, names, references) of each tile of such a stream that has both."""
    parts: list[pa.RecordBatch] = []
    key: tuple | None = None

    def close() -> Iterator[tuple[str, pa.Table, pa.Table]]:
        whole = pa.Table.from_batches(parts)
        n = pc.sum(whole.column("is_ref")).as_py() or 0
        if 0 < n < whole.num_rows:
            yield key[0], whole.slice(n), whole.slice(0, n)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c) for c in ("source_id", "i", "j")]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            changed[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            here = tuple(c[a].as_py() for c in columns)
            if parts and here != key:
                yield from close()
                parts = []
            key = here
            parts.append(batch.slice(a, b - a))
    if parts:
        yield from close()
