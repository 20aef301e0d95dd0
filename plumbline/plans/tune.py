"""Choosing alpha and theta, on the train split only.

Both stay in DataFrames until the last one-row result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import EvalSettings
from plumbline.functions.text import risk
from plumbline.operators import stats

#: Taken where no alpha of the grid has a defined AUC: the value nearest to this.
FALLBACK_ALPHA = 0.7


def train_only(scored: DataFrame) -> DataFrame:
    return scored.filter("split = 'train'")


def alpha_grid(scored: DataFrame, settings: EvalSettings | None = None, key: str = "response_id") -> DataFrame:
    """(grid_pos, alpha, n_folds, AUC): mean AUC over validation folds for each
    alpha. Fewer than two folds, as many as the smaller class has rows, give
    the AUC over all rows; undefined folds are left out."""
    settings = settings or EvalSettings()
    rows = train_only(scored).filter("not unscorable").select(key, "y", "EG", "RP")
    folds = F.least("least", F.lit(settings.alpha_folds).cast("long"))
    dealt = stats.numbered(rows, key, settings.seed, "y").withColumn("folds", folds)
    dealt = dealt.withColumn("fold", F.when(F.col("folds") >= 2, F.col("r") % F.col("folds")).otherwise(F.lit(0).cast("long")))
    grid = F.array(*(F.struct(F.lit(i).alias("grid_pos"), F.lit(float(a)).alias("alpha")) for i, a in enumerate(settings.alpha_grid)))
    each = dealt.select("y", "EG", "RP", "fold", F.explode(grid).alias("g")).select("y", "fold", "g.grid_pos", "g.alpha", "EG", "RP")
    each = each.withColumn("H", risk(F.col("EG"), F.col("RP"), F.col("alpha")))
    folds = stats.auc(each, by=["grid_pos", "alpha", "fold"])
    return folds.groupBy("grid_pos", "alpha").agg(F.count("AUC").alias("n_folds"), F.avg("AUC").alias("AUC"))


def best_alpha(grid: DataFrame, settings: EvalSettings | None = None) -> DataFrame:
    """One row (alpha, AUC): the best of the grid, the first of equals."""
    settings = settings or EvalSettings()
    if_none = min(settings.alpha_grid, key=lambda a: abs(a - FALLBACK_ALPHA))
    best = grid.filter("AUC is not null").agg(F.min(F.struct((-F.col("AUC")).alias("a"), "grid_pos", "alpha")).alias("b"), F.count("*").alias("n"))
    some = grid.agg(F.count("*").alias("rows"))
    middle = settings.alpha_grid[len(settings.alpha_grid) // 2]
    default = F.when(F.col("rows") > 0, F.lit(if_none)).otherwise(F.lit(middle))
    return best.join(some).select(F.coalesce("b.alpha", default).alias("alpha"), (-F.col("b.a")).alias("AUC"))


def theta(scored: DataFrame, alpha: float) -> DataFrame:
    """One row (theta, F1) on train, unscorable answers left out."""
    rows = train_only(scored).withColumn("H", risk(F.col("EG"), F.col("RP"), alpha))
    return stats.best_threshold(rows)


def tau_sweep(train_ids: DataFrame, rescore: Callable[[DataFrame, list[tuple[float, float]]], DataFrame], alpha: float, settings: EvalSettings | None = None, key: str = "response_id") -> DataFrame:
    """(tau_e, tau_r, n, AUC) for each pair of thresholds, over a sample of the
    train answers (key, y). ``rescore(ids, pairs)`` returns their scores (key,
    tau_e, tau_r, EG, RP), all in one plan. For the report only: it never
    changes the thresholds."""
    settings = settings or EvalSettings()
    pairs = [(float(te), float(tr)) for te in settings.tau_e_sweep for tr in settings.tau_r_sweep]
    ids = stats.sample(train_ids, key, settings.sweep_limit, settings.seed)
    rows = rescore(ids, pairs).join(ids.select(key, "y"), key).withColumn("H", risk(F.col("EG"), F.col("RP"), alpha))
    found = stats.auc(rows, by=["tau_e", "tau_r"])
    every = train_ids.sparkSession.createDataFrame(pairs, "tau_e double, tau_r double")
    return every.join(F.broadcast(found), ["tau_e", "tau_r"], "left").select("tau_e", "tau_r", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "AUC")
