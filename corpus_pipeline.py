"""The corpus pipeline: from documents to shards of training text, in five stages.

Each stage takes the Parquet its predecessor left and returns what it keeps.
The first three return the columns of ``documents``. Mixing adds each row's slot
and its place in the slot as the last two columns, since files that are read
again have no order; the last stage puts the rows in that order, and adds the
shard and the place in it instead. Shards by path, and rows by place, are the
schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, minhash, mixing, quality, sharding
from plumbline.llm.common import shared_folder, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return quality.keep_passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their slot in a schedule of the sources' target weights and the place in it."""
    return mixing.with_slots(docs)


def shard_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their slots, read back from compacted shards, with their shard and place."""
    store = sharding.ShardStore(spark, shared_folder(spark, "shards"))
    store.append(mixing.in_order(docs))
    version = store.compact(ordered=True)
    return store.read(version, places=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("shard_output", shard_output),
]

#: Neither the signatures nor the schedule can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
