"""Embeddings of texts: an interface for user models, and an offline stand-in.

An embedder turns a table of distinct texts into (text, embedding) with unit
vectors. It is called once for each distinct text of a job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plumbline.functions.text import let, unit


class Embedder(Protocol):
    def embed(self, texts: DataFrame) -> DataFrame:
        """``texts`` has a column text of distinct values; returns text, embedding."""


class HashEmbedder:
    """Vectors for given texts, and for all others a direction drawn from a
    hash of the text: the same in every process."""

    def __init__(self, known: Mapping[str, Sequence[float]] | None = None, dim: int = 16):
        self.known, self.dim = dict(known or {}), dim

    #: Costs less than bringing equal texts together, so vectors can be drawn where texts are.
    row_local = True

    def vector(self, text: Column) -> Column:
        """The vector of a text."""

        # A byte of a digest for each dimension, around zero: other engines can do the same.
        def variates(digest: Column, n: int) -> Column:
            fours = F.array(*(F.conv(F.substring(digest, i * 2 + 1, 8), 16, 10).cast("long") for i in range(0, n, 4)))
            return let(fours, lambda x: F.array(*(F.shiftright(x[i // 4], 24 - i % 4 * 8).bitwiseAND(255).cast("double") - 127.5 for i in range(n))))

        def some(block: int) -> Column:
            return let(F.md5(F.concat(F.lit(f"{block}:"), text)), lambda digest: variates(digest, min(16, self.dim - 16 * block)))

        drawn = F.concat(*(some(block) for block in range(-(-self.dim // 16))))
        if self.known:
            given = F.create_map(*(x for t, v in self.known.items() for x in (F.lit(t), F.array(*(F.lit(float(y)) for y in v)))))
            drawn = F.coalesce(F.try_element_at(given, text), drawn)
        return unit(drawn)

    def draw(self, texts: Sequence[str]) -> np.ndarray:
        """The same vectors as ``vector`` has, for texts in a task."""

        blocks = -(-self.dim // 16)
        digests = b"".join(hashlib.md5(f"{block}:{text}".encode()).digest() for text in texts for block in range(blocks))
        raw = np.frombuffer(digests, dtype=np.uint8).reshape(len(texts), 16 * blocks)[:, : self.dim] - 127.5
        for i, text in enumerate(texts if self.known else ()):
            if text in self.known:
                raw[i] = self.known[text]
        squares = np.zeros(len(texts))
        for x in raw.T:  # in order
            squares += x * x
        norms = np.where(squares == 0, 1.0, np.sqrt(squares))
        return (raw / norms[:, None]).astype(np.float32)

    def embed(self, texts: DataFrame) -> DataFrame:
        return texts.select("text", self.vector(F.col("text")).alias("embedding"))


class StoredEmbedder:
    """An embedder whose vectors are kept in a table, by a hash of the text: each
    text is embedded once, however often and in however many plans it is asked
    for. Only texts that the table lacks go to the inner embedder, and what it
    gives is read from the table from then on."""

    def __init__(self, inner: Embedder, path: str):
        self.inner, self.path = inner, path

    def _stored(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema("key binary, embedding array<float>").parquet(self.path)
        except AnalysisException:  # nothing was embedded yet
            return spark.createDataFrame([], "key binary, embedding array<float>")

    def embed(self, texts: DataFrame) -> DataFrame:
        key = F.unhex(F.md5("text"))
        asked = texts.select("text").filter("text IS NOT NULL").distinct()
        new = asked.withColumn("key", key).join(self._stored(texts.sparkSession), "key", "left_anti").select("text")
        made = self.inner.embed(new).select(key.alias("key"), F.col("embedding").cast("array<float>").alias("embedding"))
        made.write.mode("append").option("compression", "zstd").parquet(self.path)
        # Two writers at once leave equal rows.
        known = self._stored(texts.sparkSession).dropDuplicates(["key"])
        return asked.withColumn("key", key).join(known, "key").select("text", "embedding")


class ModelEmbedder:
    """A user's model: ``load()`` runs once in each Python worker and returns a
    function from a list of texts to an array (n, d)."""

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.load = load

    def embed(self, texts: DataFrame) -> DataFrame:
        load = self.load

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = load()
            for batch in batches:
                vectors = np.asarray(encode(batch["text"].tolist()), dtype=np.float64)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = (vectors / np.where(norms == 0, 1, norms)).astype(np.float32)
                yield pd.DataFrame({"text": batch["text"], "embedding": list(vectors)})

        return texts.select("text").mapInPandas(run, "text string, embedding array<float>")
