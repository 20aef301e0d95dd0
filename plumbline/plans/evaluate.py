"""Evaluation of the test split: tables, summary, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.operators import stats


def imputed(rows: DataFrame, h: float) -> DataFrame:
    """Unscorable answers get a fixed H."""
    return rows.withColumn("H", F.when(F.col("unscorable"), F.lit(float(h))).otherwise(F.col("H")))


#: The run's figures in short, under the names that users of the job know.
SHORT = {"alpha": "alpha", "theta": "theta", "tau_e": "tau_e", "tau_r": "tau_r", "overall_AUC": "overall_AUC_exclude_unscorable", "overall_F1": "overall_F1", "imputed_AUC": "overall_AUC_impute"}


def short(summary: DataFrame) -> DataFrame:
    """The seven figures of a summary that are shown at the end of a run."""
    return summary.select(*(F.col(c).alias(name) for c, name in SHORT.items()))


@dataclass(frozen=True)
class Evaluation:
    """The tables of one evaluation, each a lazy DataFrame."""

    auc_by_task: DataFrame
    auc_by_model: DataFrame
    prf_by_task: DataFrame
    ablation: DataFrame
    by_length: DataFrame
    graph_stats: DataFrame
    rank_sum: DataFrame
    degenerate: DataFrame
    summary: DataFrame
    histogram: DataFrame


def evaluate(rows: DataFrame, alpha: float, theta: float, settings: Settings | None = None, n_failed: int = 0) -> Evaluation:
    """``rows`` are evaluation rows of all splits; only test is read. Tables
    leave unscorable answers out (policy a); the summary also has the figures
    with an imputed H (policy b)."""
    settings = settings or Settings()
    e, m = settings.eval, settings.matching
    test = rows.filter("split = 'test'")
    kept = test.filter("not unscorable")
    filled = imputed(test, settings.metrics.impute_h)
    degenerate = stats.degenerate_counts(test).withColumn("n_failed_extractions", F.lit(n_failed).cast("long"))

    def named(df: DataFrame, **names: str) -> DataFrame:
        return df.select(*(F.col(c).alias(n) for c, n in names.items()))

    parts = [
        named(stats.auc(kept), AUC="overall_AUC"),
        named(stats.bootstrap_auc(kept, e.n_bootstrap, e.seed), lo="overall_AUC_lo", hi="overall_AUC_hi"),
        named(stats.precision_recall(kept, theta), P="overall_P", R="overall_R", F1="overall_F1"),
        named(stats.bootstrap_f1(kept, theta, e.n_bootstrap, e.seed), lo="overall_F1_lo", hi="overall_F1_hi"),
        named(stats.auc(filled), AUC="imputed_AUC"),
        named(stats.precision_recall(filled, theta), P="imputed_P", R="imputed_R", F1="imputed_F1"),
        degenerate,
    ]
    fixed = {"alpha": alpha, "theta": theta, "tau_e": m.entity_threshold, "tau_r": m.relation_threshold}
    summary = rows.sparkSession.range(1).select(*(F.lit(float(v)).alias(k) for k, v in fixed.items()))
    for part in parts:  # one row each
        summary = summary.crossJoin(part)
    return Evaluation(
        auc_by_task=stats.auc_breakdown(kept, "task"),
        auc_by_model=stats.auc_breakdown(kept, "gen_model"),
        prf_by_task=stats.prf_breakdown(kept, theta, "task"),
        ablation=stats.ablation(kept, {"EG-only": "H_eg", "RP-only": "H_rp", "CFI (H)": "H"}),
        by_length=stats.length_buckets(kept, e.length_edges),
        graph_stats=stats.graph_stats(test),
        rank_sum=stats.with_p(stats.rank_sum(kept)),
        degenerate=degenerate,
        summary=summary,
        histogram=stats.histogram(kept, ["task", "y"], e.histogram_bins),
    )
