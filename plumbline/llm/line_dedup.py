"""Line dedup: drop lines whose normalised form occurs in many documents.

DataFrame operations only. Lines become 128-bit hashes in the row of their
document; the distinct ones of each document are exploded and counted with
map-side combination; hashes at the threshold meet the exploded lines again
in a join, and each document gets the positions it loses. Texts move once,
when those positions join the documents.

A hash that a third of all documents share is counted by partial sums. In the
join, it is one row on the small side, which is written first: Spark
broadcasts it if its size allows, and splits skewed partitions otherwise.

Nulls and odd input: a null or empty text is one empty line, whose key is too
short to be counted. Each row is a document: a repeated row counts again, and
gets its own result row. Ids may be null. An empty table gives an empty
result. Columns other than the two named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER, text_key, written

#: The characters [\\x20\\x09-\\x0D].
SPACES = " \t\n\x0b\x0c\r"


def line_keys(lines: Column) -> Column:
    """Lines without white space at their ends, A-Z lower-cased and no other letters.

    ``translate`` goes by characters and is slow; lines of ASCII alone do
    without. Each step is an array, as what a lambda is given as an expression
    is worked out again for each use.
    """

    def lowered(line: Column) -> Column:
        return F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))

    return F.transform(F.transform(lines, lambda line: F.btrim(line, F.lit(SPACES))), lowered)


def line_hashes(lines: Column, min_chars: int) -> Column:
    """A hash for each line, null where its key is shorter than ``min_chars``."""
    return F.transform(line_keys(lines), lambda key: F.when(F.length(key) >= min_chars, F.md5(key)))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_lines, n_dropped and kept_text of every document.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents loses all its lines, in every document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), F.split(text, "\n").alias("lines"))
    hashed = base.select("id", "key", line_hashes(F.col("lines"), min_chars).alias("hashes"))

    each = hashed.select(F.explode(F.array_distinct("hashes")).alias("hash")).filter("hash is not null").select(F.unhex("hash").alias("hash"))
    # Written, so that the join can broadcast it if it is small, and split hot hashes if not.
    common = written(each.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("hash"), "common")
    lines = hashed.select("id", "key", F.posexplode("hashes").alias("at", "hash")).filter("hash is not null")
    lost = lines.withColumn("hash", F.unhex("hash")).join(common, "hash")
    dropped = lost.groupBy("id", "key").agg(F.collect_set("at").alias("dropped"))

    d = dropped.select(F.col("id").alias("d_id"), F.col("key").alias("d_key"), "dropped")
    joined = base.join(d, (F.col("key") == F.col("d_key")) & F.col("id").eqNullSafe(F.col("d_id")), "left")
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.when(F.col("dropped").isNull(), places).otherwise(F.array_except(places, F.col("dropped")))
    return joined.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(kept)).cast("long").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n").alias("kept_text"),
    )
