"""Where results go: scored records, CSV tables, audit records, the report."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.config import Settings
from plumbline.operators.graph import TRIPLE
from plumbline.operators.score import SIZES
from plumbline.sources.store import Store, arrow_path

SCORE = ", ".join(f"{s}:bigint" for s in SIZES) + (
    ", EG:double, RP:double, RP_defined:boolean, unscorable:boolean, ref_empty:boolean, matched_entities:array<struct<v:string,ref:string,method:string>>, "
    f"ungrounded_entities:array<string>, supported_relations:array<{TRIPLE}>, unsupported_relations:array<{TRIPLE}>"
)
SWEPT = "array<struct<tau_e:double,tau_r:double,n:bigint,AUC:double>>"
SCORED = f"response_id string, source_id string, task string, gen_model string, split string, y int, context_len int, gt_span_types array<string>, score struct<{SCORE}>"


def write_scored(instances: DataFrame, scores: DataFrame, path: str) -> None:
    """One nested JSON record per scored answer."""
    fields = [c for c in scores.columns if c not in ("response_id", "source_id")]
    facts = instances.select("response_id", "source_id", "task", "gen_model", "split", "y", F.length("context").alias("context_len"), "gt_span_types")
    facts.join(scores.select("response_id", F.struct(*fields).alias("score")), "response_id").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tuning(alpha: float, best: dict[str, Any], grid: DataFrame, thresholds: DataFrame | None, path: str) -> None:
    """One record: alpha, theta, train_f1, and the traces of both searches."""
    trace = grid.agg(F.transform(F.array_sort(F.collect_list(F.struct("grid_pos", "alpha", "AUC"))), lambda g: F.struct(g["alpha"].alias("alpha"), g["AUC"].alias("AUC"))).alias("alpha_cv"))
    if thresholds is None:
        swept = grid.sparkSession.range(1).select(F.array().cast(SWEPT).alias("tau_sweep"))
    else:
        swept = thresholds.agg(F.array_sort(F.collect_list(F.struct("tau_e", "tau_r", "n", "AUC"))).alias("tau_sweep"))
    chosen = (F.lit(v).cast("double").alias(k) for k, v in (("alpha", alpha), ("theta", best["theta"]), ("train_f1", best["F1"])))
    trace.join(swept).select(*chosen, "alpha_cv", "tau_sweep").coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_tuning(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"alpha double, theta double, train_f1 double, alpha_cv array<struct<alpha:double,AUC:double>>, tau_sweep {SWEPT}").json(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored records, flat; missing lists are empty."""
    raw = spark.read.schema(SCORED).json(path)
    flat = raw.select(*(c for c in raw.columns if c != "score"), "score.*")
    lists = [f.name for f in flat.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return flat.withColumns({c: F.coalesce(c, F.array().cast(flat.schema[c].dataType)) for c in lists})


def write_failures(failures: DataFrame, path: str) -> None:
    """(stage, id, error) records of what was not extracted or skipped."""
    failures.select("stage", "id", "error").write.mode("append").json(path)


def running_calls(log: DataFrame) -> DataFrame:
    """The extraction log with running sums of calls, tokens and cost, in order
    of its keys: summed within ranges of keys, after what the ranges before hold."""
    sums = {"cum_calls": (~F.col("cached")).cast("long"), "cum_prompt_tokens": F.col("prompt_tokens"), "cum_completion_tokens": F.col("completion_tokens"), "cum_cost_usd": F.col("cost_usd")}
    ranged = log.withColumn("part", F.substring("cache_key", 1, 2))
    parts = ranged.groupBy("part").agg(*(F.sum(x).alias(c) for c, x in sums.items()))
    parts = parts.select("part", *((F.sum(c).over(Window.orderBy("part")) - F.col(c)).alias(f"{c}_before") for c in sums))  # 256 rows at most
    order = Window.partitionBy("part").orderBy("cache_key", "owner").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({c: F.sum(x).over(order) for c, x in sums.items()}).join(F.broadcast(parts), "part")
    return summed.select(*log.columns, *((F.col(f"{c}_before") + F.col(c)).alias(c) for c in sums))


def write_usage(log: DataFrame, path: str) -> None:
    running_calls(log).write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_audit(records: DataFrame, path: str, one_file_each: bool = False) -> None:
    """Audit records as a JSON data set; or as one file for each answer, with its
    id as the name, written by the tasks to the run's own store."""
    if not one_file_each:
        records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return
    place = arrow_path(path)
    if place is None:
        raise ValueError(f"files of {path} can't be written from tasks; write records instead")
    lines = records.select("response_id", F.to_json(F.struct(*records.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = arrow_path(path)
        fs.create_dir(root, recursive=True)
        n = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = f"{root}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(new) as f:
                    f.write(text.encode() + b"\n")
                fs.move(new, f"{root}/{file_name(name)}.json")  # a task that runs again puts the same in its place
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    lines.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def file_name(key: str | None) -> str:
    """A key as the name of a file; of 200 bytes at most, with a digest of what is longer."""
    name = quote(key or "", safe="").replace(".", "%2E")
    return name if len(name) <= 200 else f"{name[:150]}-{hashlib.sha256(name.encode()).hexdigest()[:40]}"


def markdown(frame: pd.DataFrame) -> str:
    """A table in Markdown: four decimals, blanks for what is undefined."""

    def cell(x: Any) -> str:
        if x is None or (isinstance(x, float) and pd.isna(x)):
            return ""
        return f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")

    rows = [list(map(str, frame.columns)), ["---"] * len(frame.columns), *([cell(x) for x in r] for r in frame.itertuples(index=False))]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def number(x: Any, form: str = ".4f") -> str:
    return "undefined" if x is None or pd.isna(x) else format(x, form)


def report(evaluation, settings: Settings, tuning: dict[str, DataFrame] | None = None, usage: DataFrame | None = None) -> str:
    """The report's text, from small tables that come to the driver."""
    s = evaluation.summary.first()
    test = evaluation.rank_sum.first()

    def sections() -> Iterator[str]:
        yield "# Grounding report"
        yield f"Extraction model `{settings.extraction.model}`, alpha {number(s['alpha'], 'g')}, theta {number(s['theta'])}, thresholds {s['tau_e']:g} (entities) and {s['tau_r']:g} (relations), empty graphs: {settings.metrics.empty_policy}."
        yield "## Test split without unscorable answers"
        yield f"AUC {number(s['overall_AUC'])} (95 % interval {number(s['overall_AUC_lo'])} to {number(s['overall_AUC_hi'])}); precision {number(s['overall_P'])}, recall {number(s['overall_R'])}, F1 {number(s['overall_F1'])} (95 % interval {number(s['overall_F1_lo'])} to {number(s['overall_F1_hi'])})."
        yield f"## With H = {settings.metrics.impute_h:g} for unscorable answers"
        yield f"AUC {number(s['imputed_AUC'])}; precision {number(s['imputed_P'])}, recall {number(s['imputed_R'])}, F1 {number(s['imputed_F1'])}."
        for title, df, order in (
            ("AUC by task", evaluation.auc_by_task, "task"),
            ("AUC by generator", evaluation.auc_by_model, "gen_model"),
            ("Precision, recall, F1 by task", evaluation.prf_by_task, "task"),
            ("Ablation", evaluation.ablation, "score"),
            ("AUC by context length", evaluation.by_length, "low"),
            ("Graph statistics", evaluation.graph_stats, "task"),
        ):
            last = F.col(order) == "OVERALL" if order not in ("low", "score") else F.lit(False)
            yield f"## {title}"
            yield markdown(df.orderBy(last, order).toPandas())
        yield "## Rank-sum test (one-sided)"
        yield f"U = {number(test['U'], '.1f')}, p = {number(test['p_value'], '.3e')}; median H {number(test['median_pos'])} of positives, {number(test['median_neg'])} of negatives."
        yield "## Degenerate cases and failures"
        yield markdown(evaluation.degenerate.toPandas())
        for title, df in (tuning or {}).items():
            yield f"## Tuning, train split only: {title}"
            yield markdown(df.toPandas())
        if usage is not None:
            yield "## Extraction calls"
            yield markdown(usage.toPandas())

    return "\n\n".join(sections()) + "\n"


def write_report(spark: SparkSession, text: str, path: str) -> None:
    """The report, on the store that the path names."""
    folder, _, name = path.rpartition("/")
    Store(spark, folder or ".").write_text(name, text)
