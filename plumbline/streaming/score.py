"""Answers scored as they arrive, against graphs that are already there.

Extraction is row-local. Each micro-batch is scored with the batch plan, so a
stream and a batch over the same answers give the same scores; the sources'
graphs are read anew for each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.config import MatchSettings
from plumbline.operators import graph
from plumbline.operators.score import score


def score_stream(answers: DataFrame, source_graphs: Callable[[], DataFrame], out: str, checkpoint: str, settings: MatchSettings | None = None, extractor: graph.Extractor | None = None) -> StreamingQuery:
    """Append the scores of a stream (response_id, source_id, response) to
    ``out``, a folder for each micro-batch. A repeated batch replaces its own
    folder, so each answer is written once."""
    extractor = extractor or graph.OfflineExtractor()

    def one(batch: DataFrame, number: int) -> None:
        texts = batch.select(batch["response_id"].alias("owner"), batch["response"].alias("text"))
        graphs, _ = graph.extract(texts, extractor)
        ready = graphs.filter("error is null").withColumnRenamed("owner", "response_id").join(batch.select("response_id", "source_id"), "response_id")
        scored = score(ready.select("response_id", "source_id", "entities", "relations"), source_graphs(), settings)
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return answers.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
