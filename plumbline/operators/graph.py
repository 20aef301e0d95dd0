"""Graphs of texts: extraction, caching, union.

A graph is two long tables keyed by its owner: entities (owner, entity) and
relations (owner, s, p, o). Extractors work on distinct texts; what they find
is kept in a table keyed by a hash of parameters and text.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, as_completed, wait
from itertools import islice
from typing import Any, Protocol, TypeVar

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import ExtractionSettings
from plumbline.functions.text import cache_key, first_tokens, let
from plumbline.operators.cache import GraphCache, Portions, line

A, B = TypeVar("A"), TypeVar("B")

TRIPLE = "struct<s:string,p:string,o:string>"
GRAPH = f"entities array<string>, relations array<{TRIPLE}>"
#: What calls used: null or nothing where a backend doesn't tell.
USED = {"prompt_tokens": "bigint", "completion_tokens": "bigint", "cost_usd": "double"}
CACHE = f"cache_key string, {GRAPH}, error string, seconds double, finished double, " + ", ".join(f"{c} {t}" for c, t in USED.items())
STORED = f"{CACHE}, run string"
COLUMNS = ["cache_key", "entities", "relations", "error", "seconds", "finished", *USED]

#: Distinct tokens that the offline extractor takes as entities (a fixed value).
MAX_ENTITIES = 12
CO_OCCURS = "co_occurs_with"


class Extractor(Protocol):
    def extract(self, texts: DataFrame) -> DataFrame:
        """From (cache_key, text) to (cache_key, entities, relations, error, seconds) and the columns of ``USED``."""


def chained(entities: Column | str) -> Column:
    """Relations of each entity with the next."""
    pairs = F.zip_with(entities, F.slice(entities, 2, MAX_ENTITIES), lambda a, b: F.struct(a.alias("s"), F.lit(CO_OCCURS).alias("p"), b.alias("o")))
    return F.slice(pairs, 1, F.greatest(F.size(entities) - 1, F.lit(0)))


class OfflineExtractor:
    """A toy graph without a model, in built-in functions: the first distinct
    tokens are entities, each related to the next."""

    #: Costs less than bringing equal texts together, so each row is done where it is.
    row_local = True

    def extract(self, texts: DataFrame) -> DataFrame:
        found = texts.withColumn("graph", let(first_tokens(F.col("text"), MAX_ENTITIES), lambda e: F.struct(e.alias("entities"), chained(e).alias("relations"))))
        found = found.select(*texts.columns, "graph.*")
        return found.withColumns({"error": F.lit(None).cast("string"), "seconds": F.lit(0.0), **{c: F.lit(0).cast(t) for c, t in USED.items()}}).drop("text")


def in_flight(items: Iterable[A], work: Callable[[A], B], window: int) -> Iterator[B]:
    """Results of ``work`` as they come, with at most ``window`` items begun and
    not ended; no more items are taken than that."""
    with ThreadPoolExecutor(window) as pool:
        begun: set[Future] = set()
        for item in items:
            begun.add(pool.submit(work, item))
            while len(begun) >= window:
                ended, begun = wait(begun, return_when=FIRST_COMPLETED)
                yield from (f.result() for f in ended)
        for f in as_completed(begun):
            yield f.result()


class BackendExtractor:
    """A user's backend: ``load()`` runs once in each Python worker and returns
    an object with ``generate(input_data=, cluster=[, chunk_size=])`` whose
    result has ``entities`` and ``relations``, and may have ``usage`` with
    ``prompt_tokens``, ``completion_tokens`` and ``cost_usd``. Calls are retried
    with growing waits; what still fails is reported in ``error``.

    Each worker keeps ``settings.concurrency`` calls in flight, from threads of
    its own, so ``generate`` must bear that. With a cache, every
    ``settings.portion_calls`` results are committed as they come, and a task
    that is run again goes on after those."""

    def __init__(self, load: Callable[[], Any], settings: ExtractionSettings | None = None):
        self.load, self.settings = load, settings or ExtractionSettings()

    def call(self, backend: Any, key: str, text: str) -> dict[str, Any]:
        """One row of the cache."""
        settings = self.settings
        options = {"chunk_size": settings.chunk_chars} if len(text) > settings.chunk_chars else {}
        out: dict[str, Any] = {"cache_key": key, "entities": [], "relations": [], "error": None}
        used, began = [0 for _ in USED], time.time()
        for attempt in range(settings.max_retries):
            if attempt:
                time.sleep(settings.backoff_base_s * 2 ** (attempt - 1))
            try:
                graph = backend.generate(input_data=text, cluster=settings.cluster, **options)
                triples = {tuple(map(str, r)) for r in getattr(graph, "relations", ()) if isinstance(r, (list, tuple)) and len(r) == 3}
                usage = getattr(graph, "usage", None)
                used = [getattr(usage, c, None) or 0 for c in USED]
                out |= {"entities": sorted({str(e) for e in getattr(graph, "entities", ())}), "relations": [dict(zip("spo", t)) for t in sorted(triples)], "error": None}
                break
            except Exception as e:  # noqa: BLE001  any failure of a backend is retried and then recorded
                out["error"] = f"{type(e).__name__}: {e}"
        ended = time.time()
        return out | {"seconds": ended - began, "finished": ended} | dict(zip(USED, used))

    def rows(self, texts: Iterable[tuple[str, str]], portions: Portions | None = None) -> Iterator[dict[str, Any]]:
        """Rows of the cache for (key, text), in the order in which calls end."""
        done = {r["cache_key"]: r for r in portions.done() if r["error"] is None} if portions else {}
        backend = None

        def missing() -> Iterator[tuple[str, str]]:
            nonlocal backend
            for key, text in texts:
                if key not in done:
                    backend = backend or self.load()
                    yield key, text

        yield from done.values()
        portion: list[str] = []
        for row in in_flight(missing(), lambda x: self.call(backend, *x), self.settings.concurrency):
            if portions:
                portion.append(line(row["cache_key"], json.dumps({k: v for k, v in row.items() if k != "cache_key"} | {"run": portions.run})))
                if len(portion) >= self.settings.portion_calls:
                    portions.commit(portion)
                    portion = []
            yield row
        if portion:
            portions.commit(portion)

    def extract(self, texts: DataFrame, portions: Callable[[int], Portions] | None = None) -> DataFrame:
        """With ``portions``, which gives a task its place in the cache, results are committed there."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place = portions(TaskContext.get().partitionId()) if portions else None
            pairs = (x for batch in batches for x in zip(batch["cache_key"], batch["text"]))
            rows = self.rows(pairs, place)
            while some := list(islice(rows, 256)):
                yield pd.DataFrame(some, columns=COLUMNS)

        n = self.settings.partitions or texts.sparkSession.sparkContext.defaultParallelism
        # A key's task is the same in every attempt.
        return texts.select("cache_key", "text").repartition(n, "cache_key").mapInPandas(run, CACHE)


def graph_texts(sources: DataFrame) -> DataFrame:
    """(source_id, kind, text) of the context and the query of each source, once."""
    one = sources.dropDuplicates(["source_id"])
    return one.select("source_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in ("context", "query")))).alias("x")).select("source_id", "x.kind", "x.text")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Results that can be used again, one row a key; a missing cache is empty, and damaged lines are misses."""
    found = GraphCache(spark, path, STORED).read()
    whole = F.coalesce(F.forall("relations", lambda r: r["s"].isNotNull() & r["p"].isNotNull() & r["o"].isNotNull()), F.lit(False))
    return found.filter(F.col("entities").isNotNull() & F.col("error").isNull() & whole)


def _finished(rows: DataFrame) -> DataFrame:
    """Rows of an extractor with the time, where it does not tell."""
    return rows if "finished" in rows.columns else rows.withColumn("finished", F.unix_micros(F.current_timestamp()) / 1e6)


def extract(texts: DataFrame, extractor: Extractor, settings: ExtractionSettings | None = None, cache_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Graphs of (owner, text): (owner, entities, relations, error), and the
    log (owner, cache_key, cached, seconds, and the columns of ``USED``). Blank
    texts have empty graphs and cost no call; equal texts cost one, which the
    log gives to the first owner. With a cache path, what is new is appended
    there."""
    settings = settings or ExtractionSettings()
    text, space = F.coalesce("text", F.lit("")), r"[\s\x1c-\x1f\x85\p{Z}]"
    bare = F.when(F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))).rlike(space), F.regexp_replace(text, f"^{space}+|{space}+$", "")).otherwise(text)
    trimmed = texts.select("owner", bare.alias("text"))
    keyed = trimmed.withColumn("cache_key", F.when(F.col("text") != "", cache_key(F.col("text"), settings)))
    if cache_path is None and getattr(extractor, "row_local", False):
        done = extractor.extract(keyed)
        log = done.filter(F.col("cache_key").isNotNull()).select("owner", "cache_key", F.lit(False).alias("cached"), "seconds", *USED)
        return done.select("owner", "entities", "relations", "error"), log
    wanted = keyed.filter(F.col("cache_key").isNotNull()).select("cache_key", "text").dropDuplicates(["cache_key"])
    if cache_path is None:
        found = extractor.extract(wanted).withColumn("cached", F.lit(False))
    else:
        spark, run = texts.sparkSession, uuid.uuid4().hex
        cache = GraphCache(spark, cache_path, STORED)
        fresh = wanted.join(read_cache(spark, cache_path).select("cache_key"), "cache_key", "left_anti")
        portions = cache.portions(run) if isinstance(extractor, BackendExtractor) else None
        if portions:
            extractor.extract(fresh, portions).write.format("noop").mode("overwrite").save()
        else:
            cache.append(_finished(extractor.extract(fresh)), run)
        # Read back: the backend is called once, whatever is done with the result.
        everything = cache.read(run).join(wanted.select("cache_key"), "cache_key", "left_semi")
        found = everything.withColumn("cached", ~F.col("run").eqNullSafe(F.lit(run))).drop("run", "finished")
    joined = keyed.select("owner", "cache_key").join(found, "cache_key", "left")
    graphs = joined.select(
        "owner",
        F.coalesce("entities", F.array().cast("array<string>")).alias("entities"),
        F.coalesce("relations", F.array().cast(f"array<{TRIPLE}>")).alias("relations"),
        "error",
    )
    payers = keyed.filter(F.col("cache_key").isNotNull()).groupBy("cache_key").agg(F.min("owner").alias("payer"))
    paid = joined.filter(F.col("cache_key").isNotNull()).join(payers, "cache_key")
    paid = paid.withColumn("cached", F.coalesce("cached", F.lit(False)) | (F.col("owner") != F.col("payer")))
    cost = (F.when(F.col("cached"), 0).otherwise(F.coalesce(c, F.lit(0))).cast(t).alias(c) for c, t in {"seconds": "double", **USED}.items())
    log = paid.select("owner", "cache_key", "cached", *cost)
    return graphs, log


def entities_of(graphs: DataFrame) -> DataFrame:
    """(owner, entity), each once."""
    return graphs.select("owner", F.explode(F.array_distinct("entities")).alias("entity"))


def relations_of(graphs: DataFrame) -> DataFrame:
    """(owner, s, p, o), each once."""
    return graphs.select("owner", F.explode(F.array_distinct("relations")).alias("r")).select("owner", "r.s", "r.p", "r.o")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set union of two entity or relation tables."""
    return a.unionByName(b).distinct()


def usage(log: DataFrame) -> DataFrame:
    """Calls, cache hits, seconds, tokens and cost of an extraction log, in one row."""
    sums = (F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in {"seconds": "double", **USED}.items())
    return log.agg(F.count_if(~F.col("cached")).alias("calls"), F.count_if("cached").alias("cache_hits"), *sums)
