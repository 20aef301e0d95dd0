"""The pipeline's roles over general tables: documents, conversations, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_documents(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """Documents as instances: the first half of a text is the context, the rest
    the answer, and low quality the label to predict. Those with a label only,
    or all of them, without one."""
    d = table(spark, sf_dir, "documents")
    d = d.join(table(spark, sf_dir, "labels"), "doc_id") if labelled else d.withColumn("quality", F.lit(None).cast("int"))
    half = F.floor(F.length("text") / 2).cast("int")
    return d.select(
        F.col("doc_id").cast("string").alias("response_id"), F.col("doc_id").cast("string").alias("source_id"), F.col("lang").alias("task"), F.col("source").alias("gen_model"),
        F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
        F.substring("text", F.lit(1), half).alias("context"), F.lit(None).cast("string").alias("query"), F.substring(F.col("text"), half + 1, F.length("text")).alias("response"),
        (1 - F.col("quality")).cast("int").alias("y"), F.array().cast("array<string>").alias("gt_span_types"),
    )


def dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers: the latest user turn before is the query, all
    earlier turns, joined, the context."""
    c = table(spark, sf_dir, "conversations")
    order = "over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)"
    said = c.select(
        "conv_id", "turn", "role", "text",
        F.expr(f"array_join(collect_list(text) {order}, '\\n')").alias("context"),
        F.expr(f"last(if(role = 'user', text, null), true) {order}").alias("query"),
    ).filter("role = 'assistant'")
    name = F.concat_ws("-", "conv_id", "turn")
    return said.select(name.alias("response_id"), name.alias("source_id"), "context", "query", F.col("text").alias("response"))
