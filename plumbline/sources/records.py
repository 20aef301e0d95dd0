"""JSON-lines sources and answers, joined to instances.

``source_info`` is text, an object or anything else, depending on the task. It
is read as raw text, which keeps key order and the spelling of numbers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from plumbline.functions.serialize import business_text
from plumbline.functions.text import truthy

SOURCE = "source_id string, task_type string, source string, source_info string, prompt string"
SPAN = "struct<start:int,end:int,text:string,label_type:string,meta:string,due_to_null:string,implicit_true:string>"
RESPONSE = f"id string, source_id string, model string, temperature double, labels array<{SPAN}>, split string, quality string, response string"
TASKS = ("QA", "Data2txt", "Summary")

_BLANK = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _BLANK, "")


def with_place(raw: DataFrame) -> DataFrame:
    """Rows of files with ``place``, by which they stand in the order of the
    files: lines follow their file's blocks, and within a block the scan."""
    meta = raw.metadataColumn("_metadata")
    return raw.withColumn("place", F.struct(meta["file_path"], meta["file_block_start"], F.monotonically_increasing_id()))


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with their ``place``, ``unreadable``, the text of a line that does not fit the schema,
    and ``wrong`` where such a line is no JSON object."""
    fields = f"{schema}, unreadable string"
    try:
        raw = spark.read.schema(fields).option("columnNameOfCorruptRecord", "unreadable").json(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} is missing: a folder of records has source_info.jsonl and response.jsonl") from e
    # A field of another type is null, as in a record without it; the line as a whole is right.
    object_like = F.startswith(stripped(F.col("unreadable")), F.lit("{")) & F.try_parse_json("unreadable").isNotNull()
    return with_place(raw).withColumn("wrong", F.col("unreadable").isNotNull() & ~object_like)


def read_records(spark: SparkSession, path: str, schema: str, on_bad: str = "fail") -> DataFrame:
    """Records of a file with their ``place``. A line that is no JSON object is an
    error, or, with ``on_bad="aside"``, left to ``bad_records``. Blank lines and a
    bare ``null`` say nothing; objects in one list on a line are so many records."""
    if on_bad not in ("fail", "aside"):
        raise ValueError(f"on_bad is fail or aside, not {on_bad}")
    lines = _parsed(spark, path, schema)
    if on_bad == "fail":
        stop = F.raise_error(F.concat(F.lit("no JSON object in "), F.col("place.file_path"), F.lit(": "), F.substring("unreadable", 1, 200)))
        rows = lines.filter(F.when(F.col("wrong"), stop.cast("boolean")).otherwise(F.lit(True)))
    else:
        rows = lines.filter(~F.col("wrong"))
    return rows.drop("unreadable", "wrong")


def bad_records(spark: SparkSession, folder: str) -> DataFrame:
    """(stage, id, error) of the lines that ``on_bad="aside"`` leaves out, for the failure sink: the id is the file's."""
    told = []
    for name, schema in (("source_info.jsonl", SOURCE), ("response.jsonl", RESPONSE)):
        lines = _parsed(spark, f"{folder}/{name}", schema)
        # Always so; a scan has to read a field besides the text of unreadable lines.
        read = F.hash(*(c for c in lines.columns if c not in ("unreadable", "wrong", "place"))) >= -(1 << 31)
        told.append(lines.filter(F.col("wrong") & read).select(F.lit("read").alias("stage"), F.col("place.file_path").alias("id"), F.concat(F.lit("no JSON object: "), F.substring("unreadable", 1, 200)).alias("error")))
    return told[0].unionByName(told[1])


def read_sources(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """Source records; of those with one id, the last in file order."""
    latest = read_records(spark, path, SOURCE, on_bad)
    last = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("place")))
    return latest.withColumn("last", last).filter("last = 1").drop("last", "place")


def read_responses(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """Response records, with their place in the file."""
    return read_records(spark, path, RESPONSE, on_bad)


def context_and_query(sources: DataFrame) -> DataFrame:
    """``sources`` with context and query. An unknown task, or information that
    isn't an object where one is needed, is an error."""
    info = F.col("source_info")
    is_object = F.coalesce(info.rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(False))

    def need_object(value: Column) -> Column:
        wrong = F.raise_error(F.concat(F.lit("source_info must be an object: "), F.coalesce("source_id", F.lit("null"))))
        return F.when(is_object, value).otherwise(wrong.cast("string"))

    passages = stripped(F.coalesce(F.get_json_object(info, "$.passages"), F.lit("")))
    question = F.nullif(stripped(F.coalesce(F.get_json_object(info, "$.question"), F.lit(""))), F.lit(""))
    task = F.col("task_type")
    # The serializer sees the rows of its task only.
    business = business_text(F.when(task == "Data2txt", info))
    unknown = F.raise_error(F.concat(F.lit("unknown task_type: "), F.coalesce(task, F.lit("null")))).cast("string")
    context = F.when(task == "QA", need_object(passages)).when(task == "Data2txt", need_object(business)).when(task == "Summary", stripped(F.coalesce(info, F.lit("")))).otherwise(unknown)
    return sources.withColumn("context", context).withColumn("query", F.when(task == "QA", question))


def span_types(labels: Column, exclude_implicit_true: bool) -> Column:
    """Types of the spans that count. Spans due to nulls always count."""
    spans = F.coalesce(labels, F.array().cast(f"array<{SPAN}>"))
    if exclude_implicit_true:
        spans = F.filter(spans, lambda s: ~truthy(s["implicit_true"]))
    return F.transform(spans, lambda s: F.coalesce(s["label_type"], F.lit("Unknown")))


def build_instances(responses: DataFrame, sources: DataFrame, splits: Iterable[str] | None = None, exclude_implicit_true: bool = False) -> DataFrame:
    """Answers joined with their sources; answers without one are dropped."""
    split = F.coalesce("split", F.lit(""))
    wanted = responses if splits is None else responses.filter(split.isin(*splits))
    ready = context_and_query(sources).select("source_id", F.col("task_type").alias("task"), "context", "query", F.coalesce("prompt", F.lit("")).alias("prompt"))
    types = span_types(F.col("labels"), exclude_implicit_true)
    return wanted.join(ready, "source_id").select(
        F.col("id").alias("response_id"), "source_id", "task", F.coalesce("model", F.lit("unknown")).alias("gen_model"), split.alias("split"),
        "context", "query", F.coalesce("response", F.lit("")).alias("response"),
        (F.size(types) > 0).cast("int").alias("y"), types.alias("gt_span_types"), F.coalesce("quality", F.lit("")).alias("quality"), "prompt",
    )


def load_instances(spark: SparkSession, folder: str, splits: Iterable[str] | None = None, exclude_implicit_true: bool = False, limit: int | None = None, on_bad: str = "fail") -> DataFrame:
    """Instances of ``source_info.jsonl`` and ``response.jsonl`` in a folder;
    with ``limit``, of the first so many answers that have a source."""
    responses, sources = read_responses(spark, f"{folder}/response.jsonl", on_bad), read_sources(spark, f"{folder}/source_info.jsonl", on_bad)
    if limit:
        known = responses.join(sources.select("source_id"), "source_id", "left_semi")
        if splits is not None:
            known = known.filter(F.coalesce("split", F.lit("")).isin(*splits))
        responses = known.orderBy("place").limit(limit)
    return build_instances(responses, sources, splits, exclude_implicit_true)


def split_counts(instances: DataFrame) -> DataFrame:
    return instances.groupBy("split").agg(F.count("*").alias("n"))
