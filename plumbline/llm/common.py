"""Small helpers the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing ASCII only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """128-bit key of a text; equal texts, and only they, share it. Null is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever it has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the store that driver and executors share.

    It lies in ``spark.checkpoint.dir``; where that is unset, as in tests on
    one machine, in the warehouse folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/.scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared store and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    # Spark drops the shuffle files behind a plan when the driver collects it as garbage.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
