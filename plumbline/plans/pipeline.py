"""The whole job: load, extract, score, tune, evaluate, explain."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import MatchSettings, Settings
from plumbline.functions.embed import Embedder, StoredEmbedder
from plumbline.operators import graph, score
from plumbline.plans import evaluate, tune
from plumbline.sources.store import written


@dataclass(frozen=True)
class Graphs:
    """Graphs of sources (source_id, kind, entities, relations) and answers
    (response_id, source_id, entities, relations), what failed, and the log."""

    sources: DataFrame
    answers: DataFrame
    failures: DataFrame
    log: DataFrame


def _flat(instances: DataFrame, extractor: graph.Extractor, settings: Settings) -> DataFrame:
    """A row for each text of each instance: (kind, source_id, response_id, entities, relations, error)."""
    texts = (F.struct(F.struct(F.lit(k).alias("kind"), "source_id", "response_id").alias("owner"), F.col(c).alias("text")) for k, c in (("context", "context"), ("query", "query"), ("answer", "response")))
    graphs, _ = graph.extract(instances.select(F.explode(F.array(*texts)).alias("x")).select("x.*"), extractor, settings.extraction)
    return graphs.select("owner.*", "entities", "relations", "error")


def _firsts() -> dict[str, Column]:
    """Of the rows of a source, the context and the query of the first."""
    row = F.struct("response_id", "kind", "entities", "relations", "error")
    return {k: F.min(F.when(F.col("kind") == k, row)) for k in ("context", "query")}


def _in_the_row(instances: DataFrame, extractor: graph.Extractor, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Graphs of sources (source_id, kind, ..) and answers (response_id, source_id, ..), written in one pass over the instances."""
    flat = written(_flat(instances, extractor, settings), "graphs")
    # By the source alone: what is then done for each source needs no exchange of its own.
    firsts = flat.filter("kind <> 'answer'").groupBy("source_id").agg(*(first.alias(k) for k, first in _firsts().items()))
    of_source = firsts.select("source_id", F.explode(F.array("context", "query")).alias("first"))
    answers = flat.filter("kind = 'answer' AND response_id IS NOT NULL").select("response_id", "source_id", "entities", "relations", "error")
    sources = of_source.select("source_id", "first.kind", "first.entities", "first.relations", "first.error")
    if flat.filter("error IS NOT NULL").isEmpty():  # said in the plan, joins with what failed fall away
        sources, answers = (x.withColumn("error", F.lit(None).cast("string")) for x in (sources, answers))
    return sources, answers


def paired_graphs(instances: DataFrame, extractor: graph.Extractor | None = None, settings: Settings | None = None) -> DataFrame:
    """(response_id, source_id, entities, relations, context, query): answers beside the graphs of their source.

    The same graphs as of ``extract_graphs``, without those that failed, for an extractor that works within
    the row: texts of a source meet in one exchange, with no join, and nothing is written before.
    """
    flat = _flat(instances, extractor or graph.OfflineExtractor(), settings or Settings()).filter("source_id IS NOT NULL")
    of_source = Window.partitionBy("source_id")
    beside = flat.select("*", *(first.over(of_source).alias(k) for k, first in _firsts().items()))
    sound = beside.filter("kind = 'answer' AND response_id IS NOT NULL AND error IS NULL AND context.error IS NULL AND query.error IS NULL")
    return sound.select("response_id", "source_id", "entities", "relations", *(F.struct(f"{k}.entities", f"{k}.relations").alias(k) for k in ("context", "query")))


def extract_graphs(instances: DataFrame, extractor: graph.Extractor | None = None, settings: Settings | None = None, cache_path: str | None = None) -> Graphs:
    """Graphs of all texts. Each distinct text is extracted once; answers of a
    source that failed are skipped and listed. An extractor that works within
    the row takes all texts in one pass, and graphs are written; of the rows of
    one source the one with the first response_id counts."""
    settings, extractor = settings or Settings(), extractor or graph.OfflineExtractor()
    texts = graph.graph_texts(instances.select("source_id", "context", "query"))
    of_source = texts.select(F.struct(F.lit("source").alias("of"), F.col("source_id").alias("id"), "kind").alias("owner"), "text")
    of_answer = instances.select(F.struct(F.lit("answer").alias("of"), F.col("response_id").alias("id"), F.lit("answer").alias("kind")).alias("owner"), F.col("response").alias("text"))
    graphs, log = graph.extract(of_source.unionByName(of_answer), extractor, settings.extraction, cache_path)
    if cache_path is None and getattr(extractor, "row_local", False):
        all_sources, all_answers = _in_the_row(instances, extractor, settings)
    else:
        flat = graphs.select("owner.of", "owner.id", "owner.kind", "entities", "relations", "error")
        all_sources = flat.filter("of = 'source'").withColumnRenamed("id", "source_id")
        all_answers = flat.filter("of = 'answer'").withColumnRenamed("id", "response_id").join(instances.select("response_id", "source_id"), "response_id")
    bad = all_sources.filter("error is not null").groupBy("source_id").agg(F.min("error").alias("error"))
    sources = all_sources.join(bad, "source_id", "left_anti").select("source_id", "kind", "entities", "relations")
    skipped = all_answers.join(bad.select("source_id"), "source_id", "left_semi")
    tried = all_answers.join(bad.select("source_id"), "source_id", "left_anti")
    failures = bad.select(F.lit("reference").alias("stage"), F.col("source_id").alias("id"), "error")
    failures = failures.unionByName(tried.filter("error is not null").select(F.lit("response").alias("stage"), F.col("response_id").alias("id"), "error"))
    failures = failures.unionByName(skipped.select(F.lit("skipped").alias("stage"), F.col("response_id").alias("id"), F.lit("its reference failed").alias("error")))
    return Graphs(sources, tried.filter("error is null").select("response_id", "source_id", "entities", "relations"), failures, log)


def scores(instances: DataFrame, graphs: Graphs, settings: MatchSettings | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Scores with the facts that tuning and evaluation need."""
    scored = score.score(graphs.answers, graphs.sources, settings, embedder)
    return instances.select("response_id", "task", "gen_model", "split", F.col("y").cast("int").alias("y"), F.length("context").alias("context_len"), "gt_span_types").join(scored, "response_id")


def sweep(instances: DataFrame, graphs: Graphs, alpha: float, settings: Settings, embedder: Embedder | None) -> DataFrame:
    """The threshold sweep over train answers that have both graphs."""
    ids = tune.train_only(instances).join(graphs.answers, "response_id", "left_semi").join(graphs.sources, "source_id", "left_semi").select("response_id", "source_id", "y")

    def rescore(some: DataFrame, pairs: list[tuple[float, float]]) -> DataFrame:
        answers = graphs.answers.join(some.select("response_id"), "response_id", "left_semi")
        sources = graphs.sources.join(some.select("source_id"), "source_id", "left_semi")
        return score.score(answers, sources, settings.matching, embedder, pairs).select("response_id", "tau_e", "tau_r", "EG", "RP")

    return tune.tau_sweep(ids, rescore, alpha, settings.eval)


#: In their order; each takes what those before it left under ``out``.
STAGES = ("extract", "score", "tune", "evaluate")


def run(
    instances: DataFrame, out: str, settings: Settings | None = None, extractor: graph.Extractor | None = None, embedder: Embedder | None = None,
    cache_path: str | None = None, audit: bool | str = True, with_sweep: bool = True, stage: str = "all", bad: DataFrame | None = None,
) -> evaluate.Evaluation | None:
    """All stages, or one of ``STAGES``, their results under ``out``.

    Scores and tuning are written and read again, so that ``tune`` and
    ``evaluate`` go on from an earlier run; they fail if it left none. Graphs
    are kept in the cache, by default ``out``/cache if a single stage runs: the
    stages that need them (all but ``evaluate``) call the backend for new texts
    only. ``bad`` are input lines that were set aside, which stand with the
    failures. ``audit="files"`` writes a file for each answer. The result is that
    of ``evaluate``, if it runs.
    """
    from plumbline.sources import sinks

    if stage not in (*STAGES, "all"):
        raise ValueError(f"unknown stage: {stage}")
    settings = settings or Settings()
    spark = instances.sparkSession
    if embedder is not None:
        # Scores and sweep share what is embedded; later runs too, where the embedder has a name.
        embedder = StoredEmbedder(embedder, f"{out}/vectors/{getattr(embedder, 'name', None) or uuid.uuid4().hex}")
    todo = STAGES if stage == "all" else (stage,)
    graphs, n_failed, calls = None, 0, None
    if todo != ("evaluate",):
        graphs = extract_graphs(instances, extractor, settings, cache_path or (None if stage == "all" else f"{out}/cache"))
    if "extract" in todo:
        sinks.write_failures(graphs.failures if bad is None else graphs.failures.unionByName(bad), f"{out}/failures")
        sinks.write_usage(graphs.log, f"{out}/usage")
    if "score" in todo:
        sinks.write_scored(instances, score.score(graphs.answers, graphs.sources, settings.matching, embedder), f"{out}/scored")
    if "tune" in todo:
        scored = sinks.read_scored(spark, f"{out}/scored")
        grid = tune.alpha_grid(scored, settings.eval)
        fixed = settings.metrics.alpha
        if fixed is not None:
            grid = grid.withColumn("AUC", F.lit(None).cast("double"))  # nothing was searched
        alpha = fixed if fixed is not None else tune.best_alpha(grid, settings.eval).first()["alpha"]
        swept = sweep(instances, graphs, alpha, settings, embedder) if with_sweep else None
        sinks.write_tuning(alpha, tune.theta(scored, alpha).first().asDict(), grid, swept, f"{out}/tuning")
    if "evaluate" not in todo:
        return None
    if graphs is not None:
        n_failed, calls = graphs.failures.count(), graph.usage(graphs.log)
    scored, tuning = sinks.read_scored(spark, f"{out}/scored"), sinks.read_tuning(spark, f"{out}/tuning")
    chosen = tuning.first()
    scores_only = scored.drop("task", "gen_model", "split", "y", "context_len", "gt_span_types")
    rows = score.evaluation_rows(instances, scores_only, chosen["alpha"])
    sinks.write_csv(rows, f"{out}/metrics")
    result = evaluate.evaluate(rows, chosen["alpha"], chosen["theta"], settings, n_failed)
    sinks.write_csv(result.summary, f"{out}/summary")
    sinks.write_csv(result.histogram, f"{out}/histogram")
    traces = {"alpha": tuning.select(F.inline("alpha_cv")), "thresholds": tuning.select(F.inline("tau_sweep"))}
    sinks.write_report(spark, sinks.report(result, settings, traces, calls), f"{out}/report.md")
    if audit:
        records = score.audit_records(instances, scores_only, chosen["alpha"], settings.metrics.impute_h)
        sinks.write_audit(records, f"{out}/audit", one_file_each=audit == "files")
    return result
