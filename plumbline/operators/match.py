"""Matching an answer's graph against the graph of its source.

Entities go through a cascade of tiers - equal, contained, similar - inside a
source, each tier only with what the one before left over. Results are per
(source_id, norm), the distinct normalised names of a source's answers, so
equal names are matched once. Names and references of a source meet in tiles
(``tiles``), which are worked out once, whatever the tiers need of them: equal
and contained names in one pass by automata, similar ones by vectors in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import MatchSettings
from plumbline.functions.contain import contained
from plumbline.functions.embed import Embedder
from plumbline.functions.near import Blocks
from plumbline.functions.text import cosine, normalize
from plumbline.operators import tiles
from plumbline.sources.store import written


def match_exact(names: DataFrame, refs: DataFrame) -> DataFrame:
    """(source_id, norm) found as they are."""
    return names.join(refs, (names["source_id"] == refs["source_id"]) & (names["norm"] == refs["ref"]), "left_semi")


def _texts(df: DataFrame, column: str, *more: str) -> DataFrame:
    return df.select("source_id", F.col(column).alias("text"), *more)


def match_contained(names: DataFrame, refs: DataFrame, settings: MatchSettings, tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(source_id, norm, ref) pairs of which one contains the other at word
    boundaries: an automaton of a tile's names runs over its references, and one
    of its references over its names, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((source, *pair) for source, n, r in tiles.texts(batches) for pair in contained(n, r, settings.min_substring_chars, settings.stopwords))
        return tiles.batched(pairs, pa.schema([(c, pa.string()) for c in ("source_id", "norm", "ref")]))

    return tiles.dealt(_texts(names, "norm"), _texts(refs, "ref"), tile_rows).mapInArrow(run, "source_id string, norm string, ref string")


def match_named(names: DataFrame, refs: DataFrame, settings: MatchSettings, tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(source_id, norm, ref, method) of the first two tiers, in one pass: names that are references
    themselves, and of the others those with a contained one, the first in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tiles.batched(tiers(batches), pa.schema([*((c, pa.string()) for c in ("source_id", "norm", "ref")), ("tier", pa.int32())]))

    def tiers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for source, own, known in tiles.texts(batches):
            whole = set(known)
            found = {x: (0, x) for x in own if x in whole}
            if settings.allow_substring:
                for name, ref in contained([x for x in own if x not in found], known, settings.min_substring_chars, settings.stopwords):
                    found[name] = min(found.get(name, (1, ref)), (1, ref))
            yield from ((source, name, ref, tier) for name, (tier, ref) in found.items())

    found = tiles.dealt(_texts(names, "norm"), _texts(refs, "ref"), tile_rows).mapInArrow(run, "source_id string, norm string, ref string, tier int")
    # What other tiles of the source found counts as well.
    best = found.groupBy("source_id", "norm").agg(F.min(F.struct("tier", "ref")).alias("b"))
    method = F.when(F.col("b.tier") == 0, "exact").otherwise("substring")
    return best.select("source_id", "norm", F.col("b.ref").alias("ref"), method.alias("method"))


def _similar(names: DataFrame, refs: DataFrame, vectors: DataFrame, threshold: float | None, tile_rows: int) -> DataFrame:
    """(source_id, norm, ref, sim): the most similar references of a tile, or all of at least a threshold."""
    left = _texts(names, "norm").join(vectors.select("text", "embedding"), "text")
    right = _texts(refs, "ref").join(vectors.select("text", "embedding"), "text")

    def vecs(x: pa.Table) -> np.ndarray:
        flat = x.column("embedding").combine_chunks().flatten()
        return flat.to_numpy(zero_copy_only=False).reshape(x.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tiles.batched(near(batches), pa.schema([*((c, pa.string()) for c in ("source_id", "norm", "ref")), ("sim", pa.float64())]))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for source, n, r in tiles.groups(batches):
            blocks, known = Blocks(vecs(r)), r.column("text").to_pylist()
            for name, query in zip(n.column("text").to_pylist(), vecs(n)):
                some = blocks.nearest(query) if threshold is None else blocks.within(query, threshold)
                yield from ((source, name, known[i], s) for i, s in some)

    columns = ["source_id", "text", "embedding"]
    tiled = tiles.dealt(left.select(columns), right.select(columns), tile_rows)
    return tiled.mapInArrow(run, "source_id string, norm string, ref string, sim double")


def nearest(names: DataFrame, refs: DataFrame, vectors: DataFrame, tile_rows: int = tiles.TILE_ROWS // 4) -> DataFrame:
    """(source_id, norm, ref, sim): the most similar reference; of equals the
    first in order. ``vectors`` holds (text, embedding) of all names, of one
    size and with no null in them."""
    best = _similar(names, refs, vectors, None, tile_rows).groupBy("source_id", "norm").agg(F.min(F.struct((-F.col("sim")).alias("d"), "ref")).alias("b"))
    return best.select("source_id", "norm", F.col("b.ref").alias("ref"), (-F.col("b.d")).alias("sim"))


def near_pairs(names: DataFrame, refs: DataFrame, vectors: DataFrame, threshold: float, tile_rows: int = tiles.TILE_ROWS // 4) -> DataFrame:
    """(source_id, norm, ref, sim): all pairs of at least a similarity."""
    return _similar(names, refs, vectors, threshold, tile_rows)


def embed_names(embedder: Embedder, *columns: tuple[DataFrame, str]) -> DataFrame:
    """Embeddings of the distinct texts of some columns."""
    texts = None
    for df, c in columns:
        one = df.select(F.col(c).alias("text"))
        texts = one if texts is None else texts.unionByName(one)
    return embedder.embed(texts.distinct())


def match_entities(names: DataFrame, refs: DataFrame, settings: MatchSettings | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(source_id, norm, ref, method) of the names that match: exact, substring
    or embedding, the first tier that does, and in it the first reference in
    order."""
    settings = settings or MatchSettings()
    keys = names.select("source_id", "norm").filter("norm <> ''")
    found = match_named(keys, refs, settings)  # equal names are one in their tile
    if vectors is not None:
        keys = keys.distinct()
        found = written(found, "named")
        rest = keys.join(found, ["source_id", "norm"], "left_anti")
        similar = nearest(rest, refs, vectors).filter(F.col("sim") >= settings.entity_threshold)
        found = found.unionByName(similar.select("source_id", "norm", "ref", F.lit("embedding").alias("method")))
    return found


def same_ends(ends: DataFrame, ref_ends: DataFrame, settings: MatchSettings, vectors: DataFrame | None = None) -> DataFrame:
    """(source_id, end, ref_end): which ends of triples are the same thing as which of the
    references': equal, contained or similar. Each pair once."""
    n, r = ends.select("source_id", F.col("end").alias("norm")), ref_ends.select("source_id", F.col("ref_end").alias("ref"))
    pairs = n.join(r.withColumn("norm", F.col("ref")), ["source_id", "norm"]).select("source_id", "norm", "ref")
    if settings.allow_substring:
        pairs = pairs.unionByName(match_contained(n, r, settings))
    if vectors is not None:
        pairs = pairs.unionByName(near_pairs(n, r, vectors, settings.entity_threshold).drop("sim"))
    return pairs.distinct().select("source_id", F.col("norm").alias("end"), F.col("ref").alias("ref_end"))


def align_relations(triples: DataFrame, ref_triples: DataFrame, matches: DataFrame, settings: MatchSettings | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(source_id, s, p, o, ref_s, ref_p, ref_o, method) of the triples that a
    reference supports.

    ``triples`` holds distinct normalised triples of a source's answers. Both
    ends must match some reference entity, under the normalised form of the
    already normalised name; ``matches`` must cover those. Then a reference
    triple with the same or a similar predicate must have the same ends, in
    order (forward) or, if the settings accept it, swapped (inverse). The first
    reference triple in order counts, forward before inverse.

    Ends come first: which of them are the same thing is found once for each two
    names, and triples are joined by it, so that candidates are as many as ends
    that match and not as triples with one predicate.
    """
    settings = settings or MatchSettings()
    keys = triples.select("source_id", "s", "p", "o").filter("s <> '' and o <> ''").distinct()
    known = matches.select("source_id", F.col("norm").alias("gate"))
    for end in "so":
        keys = keys.withColumn("gate", normalize(F.col(end))).join(known, ["source_id", "gate"], "left_semi").drop("gate")
    keys, ref_triples = written(keys, "triples"), written(ref_triples, "references")
    ends = keys.select("source_id", F.explode(F.array("s", "o")).alias("end")).distinct()
    ref_ends = ref_triples.select("source_id", F.explode(F.array("s2", "o2")).alias("ref_end")).distinct()
    same = written(same_ends(ends, ref_ends, settings, vectors), "ends")

    def as_ends(a: str, b: str) -> DataFrame:
        return same.select("source_id", F.col("end").alias(a), F.col("ref_end").alias(b))

    def candidates(first: str, second: str, way: int) -> DataFrame:
        """Triples whose subject is the ``first`` end of a reference, and whose object the ``second``."""
        met = keys.join(as_ends("s", first), ["source_id", "s"]).join(ref_triples, ["source_id", first])
        return met.join(as_ends("o", second), ["source_id", "o", second], "left_semi").select("source_id", "s", "p", "o", "s2", "p2", "o2", F.lit(way).alias("way"))

    pairs = candidates("s2", "o2", 0)
    if settings.accepts_inverse:
        pairs = pairs.unionByName(candidates("o2", "s2", 1))
    if vectors is None:
        held = pairs.filter("p = p2")
    else:

        def vec(c: str) -> DataFrame:
            return vectors.select(F.col("text").alias(c), F.col("embedding").alias(f"e_{c}"))

        pairs = written(pairs, "pairs")
        close = pairs.select("p", "p2").distinct().join(vec("p"), "p", "left").join(vec("p2"), "p2", "left")
        close = close.filter((F.col("p") == F.col("p2")) | F.coalesce(cosine(F.col("e_p"), F.col("e_p2")) >= settings.relation_threshold, F.lit(False))).select("p", "p2")
        held = pairs.join(close, ["p", "p2"])
    best = held.groupBy("source_id", "s", "p", "o").agg(F.min(F.struct("s2", "p2", "o2", "way")).alias("b"))
    method = F.when(F.col("b.way") == 0, "forward").otherwise("inverse")
    return best.select("source_id", "s", "p", "o", F.col("b.s2").alias("ref_s"), F.col("b.p2").alias("ref_p"), F.col("b.o2").alias("ref_o"), method.alias("method"))
