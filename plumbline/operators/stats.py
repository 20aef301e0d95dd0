"""Rank statistics and resampling as grouped plans.

Every function takes the columns to group by; rows whose score is null or not
finite do not count. Undefined results are null. Rows are first reduced to
distinct scores per group, with map-side combination, so what a window sorts
is the number of distinct scores and not of rows. Distinct scores are then cut
into ``BUCKETS`` ranges of about as many: windows run inside of a range, and sums
over the ranges before it, a few rows a group, carry them on. No task thus sorts
more than its share of the largest group, OVERALL or ungrouped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.sources.store import written

OVERALL = "OVERALL"


def finite(score: str) -> Column:
    c = F.col(score).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., h, pos, neg): how many of each class have each score. Rows whose
    score does not count keep their group, under a null h with no counts."""
    kept = df.select(*by, F.when(finite(score), F.col(score).cast("double")).alias("h"), (F.col(label) == 1).alias("is_pos"))
    some = F.col("h").isNotNull()
    return kept.groupBy(*by, "h").agg(F.count_if(some & F.col("is_pos")).alias("pos"), F.count_if(some & ~F.col("is_pos")).alias("neg"))


#: Ranges that distinct scores are cut into.
BUCKETS = 128


def ranged(counts: DataFrame, by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """``counts`` (by.., h, pos, neg, ..) with ``score_range``, the range of each score, and of the
    group: ``pos_before`` and ``neg_before`` in lower ranges, ``h_before``, the last score of
    those, and ``pos_all`` and ``neg_all``."""
    counts = written(counts, "scores")  # what comes before them is worked out once
    used = F.when(F.col("pos") + F.col("neg") > 0, F.col("h"))
    edges = counts.agg(F.percentile_approx(used, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), 100 * buckets).alias("edges"))
    # One row: the ranges of all groups have the same ends.
    placed = counts.join(edges).withColumn("score_range", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("h"))), F.lit(-1))).drop("edges")
    held = placed.groupBy(*by, "score_range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.max("h").alias("h_last"))  # BUCKETS rows a group
    group = Window.partitionBy(*by)
    lower = group.orderBy("score_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"_{i}" for i in range(len(by) + 1)]
    sums = held.select(
        *(F.col(c).alias(k) for c, k in zip([*by, "score_range"], keys)),
        F.coalesce(F.sum("p").over(lower), F.lit(0)).alias("pos_before"), F.coalesce(F.sum("q").over(lower), F.lit(0)).alias("neg_before"),
        F.last("h_last", ignorenulls=True).over(lower).alias("h_before"), F.sum("p").over(group).alias("pos_all"), F.sum("q").over(group).alias("neg_all"),
    )
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
    return placed.join(sums, [*same, F.col("score_range") == F.col(keys[-1])]).drop(*keys)


def inside(by: Sequence[str], descending: bool = False):
    """The window of a score's range."""
    return Window.partitionBy(*by, "score_range").orderBy(F.desc("h") if descending else F.asc("h"))


def auc_of_counts(counts: DataFrame, by: Sequence[str] = (), *more: Column) -> DataFrame:
    """What ``auc`` returns, from (by.., h, pos, neg) with each h once, and more
    aggregates, for which scores have what ``ranged`` gives them."""
    below = inside(by).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (counts if "neg_before" in counts.columns else ranged(counts, by)).withColumn("below", F.col("neg_before") + F.coalesce(F.sum("neg").over(below), F.lit(0)))
    u = F.sum(F.col("pos") * (F.col("below") + F.col("neg") * 0.5))
    zero = F.lit(0).cast("long")
    out = ranked.groupBy(*by).agg(F.coalesce(F.sum("pos"), zero).alias("p"), F.coalesce(F.sum("neg"), zero).alias("q"), u.alias("u"), *more)
    both = (F.col("p") > 0) & (F.col("q") > 0)
    extra = out.columns[len(by) + 3 :]
    return out.select(*by, (F.col("p") + F.col("q")).alias("n"), F.col("p").alias("n_pos"), F.when(both, F.col("u")).alias("U"), F.when(both, F.col("u") / (F.col("p") * F.col("q"))).alias("AUC"), *extra)


def auc(df: DataFrame, score: str = "H", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """(by.., n, n_pos, U, AUC): the chance that a positive scores above a
    negative, ties counting half. Each group of ``df`` has a row, with counts of
    0 if no score counts. Without ``by`` there is always one row."""
    return auc_of_counts(score_counts(df, score, label, by), by)


def with_overall(df: DataFrame, group: str) -> DataFrame:
    """Every row twice: in its group, and in the group of all."""
    return df.withColumn(group, F.explode(F.array(F.col(group).cast("string"), F.lit(OVERALL))))


def auc_breakdown(df: DataFrame, group: str, score: str = "H", label: str = "y") -> DataFrame:
    """(group, n, n_pos, AUC) for each value and OVERALL; values without a score stay."""
    return auc(with_overall(df, group), score, label, [group]).drop("U")


def precision_recall(df: DataFrame, theta: float, score: str = "H", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """(by.., n, P, R, F1) of predicting the positives as score >= theta; zero
    where a ratio has no cases, null where there are no rows."""
    said, true = F.col(score) >= theta, F.col(label) == 1
    ok = finite(score)
    out = df.groupBy(*by).agg(F.count_if(ok).alias("n"), F.count_if(ok & said & true).alias("tp"), F.count_if(ok & said & ~true).alias("fp"), F.count_if(ok & ~said & true).alias("fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(F.col("n") > 0, F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)))

    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return out.select(*by, "n", ratio(tp, tp + fp).alias("P"), ratio(tp, tp + fn).alias("R"), ratio(2 * tp, 2 * tp + fp + fn).alias("F1"))


def prf_breakdown(df: DataFrame, theta: float, group: str, score: str = "H", label: str = "y") -> DataFrame:
    return precision_recall(with_overall(df, group), theta, score, label, [group])


def ablation(df: DataFrame, columns: dict[str, str], label: str = "y") -> DataFrame:
    """(score, n, AUC) of several score columns, each on its own defined rows."""
    stacked = df.select(F.col(label).alias("y"), F.explode(F.array(*(F.struct(F.lit(name).alias("score"), F.col(c).cast("double").alias("value")) for name, c in columns.items()))).alias("x"))
    return auc(stacked.select("y", "x.score", "x.value"), "value", "y", ["score"]).select("score", "n", "AUC")


def length_buckets(df: DataFrame, edges: Sequence[int], length: str = "context_len", score: str = "H", label: str = "y") -> DataFrame:
    """(bucket, mean_len, n, n_pos, AUC) for left-closed ranges of a length;
    rows outside all of them, and empty buckets, are left out."""
    name = F.lit(None).cast("string")
    low = F.lit(None).cast("long")
    for a, b in zip(edges, edges[1:]):
        inside = (F.col(length) >= a) & (F.col(length) < b)
        name, low = F.when(inside, F.lit(f"[{a},{b})")).otherwise(name), F.when(inside, F.lit(a).cast("long")).otherwise(low)
    rows = df.withColumn("bucket", name).withColumn("low", low).filter("bucket is not null")
    kept = rows.select("bucket", "low", length, F.when(finite(score), F.col(score).cast("double")).alias("h"), (F.col(label) == 1).alias("is_pos"))
    some = F.col("h").isNotNull()
    counts = kept.groupBy("bucket", "low", "h").agg(F.count_if(some & F.col("is_pos")).alias("pos"), F.count_if(some & ~F.col("is_pos")).alias("neg"), F.sum(length).alias("total"), F.count(length).alias("rows"))
    mean = F.try_divide(F.sum("total").cast("double"), F.sum("rows"))
    return auc_of_counts(counts, ["bucket", "low"], mean.alias("mean_len")).select("bucket", "low", "mean_len", "n", "n_pos", "AUC")


def best_threshold(df: DataFrame, score: str = "H", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """(by.., theta, F1): the smallest threshold with the best F1 among a point
    below the least score, all scores and the midpoints between them. Groups
    with one class have theta 0.5 and no F1; without ``by`` there is always
    one row."""
    counts = ranged(score_counts(df, score, label, by), by)
    below = inside(by).rowsBetween(Window.unboundedPreceding, -1)
    # Predicting from score h upwards is first reached at the midpoint below it.
    before = F.coalesce(F.lag("h").over(inside(by)), "h_before")
    theta = F.when(before.isNull(), F.col("h") - 1e-9).otherwise((before + F.col("h")) / 2)
    tp, fp = (F.col(f"{c}_all") - F.col(f"{c}_before") - F.coalesce(F.sum(c).over(below), F.lit(0)) for c in ("pos", "neg"))
    rows = counts.select(*by, "h", theta.alias("theta"), tp.alias("tp"), fp.alias("fp"), F.col("pos_all").alias("p"), F.col("neg_all").alias("q"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), F.lit(0.0))
    judged = F.when(F.col("h").isNotNull() & (F.col("p") > 0) & (F.col("q") > 0), F.struct((-f1).alias("f"), "theta"))
    best = rows.groupBy(*by).agg(F.min(judged).alias("b"))
    return best.select(*by, F.coalesce("b.theta", F.lit(0.5)).alias("theta"), (-F.col("b.f")).alias("F1"))


def hash_order(key: Column, seed: int) -> Column:
    """A random but reproducible order: the same in other engines."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def numbered(df: DataFrame, key: str, seed: int, by: str) -> DataFrame:
    """``df`` with ``r``, from 0 in the order of a hash within each value of
    ``by``, and ``least``, how many rows the value with the fewest has.

    Rows are numbered within ranges of the hash, after what the ranges before
    hold, so that a value is never one task.
    """
    order = hash_order(F.col(key), seed)
    ranged = written(df.withColumn("part", F.coalesce(F.substring(order, 1, 3), F.lit(""))), "numbered")
    held = ranged.groupBy(by, "part").agg(F.count("*").alias("c"))  # 4,096 rows for each value
    ahead = F.sum("c").over(Window.partitionBy(by).orderBy("part")) - F.col("c")
    parts = held.select(F.col(by).alias("v"), F.col("part").alias("in"), ahead.alias("ahead"), F.sum("c").over(Window.partitionBy(by)).alias("of"))
    parts = parts.withColumn("least", F.min("of").over(Window.partitionBy()))
    within = F.row_number().over(Window.partitionBy(by, "part").orderBy(order, key)) - 1
    return ranged.withColumn("own", within).join(parts, F.col(by).eqNullSafe(F.col("v")) & (F.col("part") == F.col("in"))).select(*df.columns, (F.col("ahead") + F.col("own")).alias("r"), "least")


def stratified_folds(df: DataFrame, key: str, folds: int, seed: int, label: str = "y") -> DataFrame:
    """``df`` with ``fold``: the classes are dealt round in the order of a hash."""
    return numbered(df, key, seed, label).withColumn("fold", (F.col("r") % folds).cast("int")).drop("r", "least")


def sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Exactly ``size`` rows without replacement, or all if there are no more."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(size)


def poisson_limits(mean: int) -> tuple[int, np.ndarray]:
    """Chances of a Poisson number of being ``first`` at most, and one more, and so on, in
    units of 2^-32 (rounded). What lies further off has no chance in these units."""
    spread = int(12 * math.sqrt(mean)) + 40
    first = max(0, mean - spread)
    k = np.arange(first, mean + spread + 1, dtype=np.float64)
    steps = np.log(mean / np.maximum(k, 1))
    logs = np.cumsum(steps) - steps[0]  # up to a factor
    chances = np.exp(logs - logs.max())
    return first, np.round(np.cumsum(chances / chances.sum()) * 2.0**32).astype(np.uint64)


def poisson_draws(seed: int, n: int, label: str, h: float, mean: int, limits: Callable[[int], tuple[int, np.ndarray]] = poisson_limits) -> np.ndarray:
    """``n`` Poisson numbers of a mean, by inverse distribution: each md5 has the chances of four."""
    if not mean:
        return np.zeros(n, dtype=np.int64)
    name = f"{label}:{h:.17g}"
    digests = b"".join(hashlib.md5(f"{seed}:{i}:{name}".encode()).digest() for i in range(-(-n // 4)))
    first, table = limits(mean)
    return first + np.searchsorted(table, np.frombuffer(digests, dtype=">u4")[:n].astype(np.uint64), side="right")


RESAMPLED = "score_range int, p array<bigint>, q array<bigint>, u array<double>, tp array<bigint>, fp array<bigint>"


def bootstrap(df: DataFrame, n: int, seed: int, score: str = "H", label: str = "y", theta: float = 0.0) -> DataFrame:
    """(b, p, q, U, tp, fp) of ``n`` resamples b = 0.., and under b = -1 of the rows
    themselves: both classes, the rank sum, and what is at ``theta`` or above.

    A Poisson bootstrap by counts: rows of one class and score are in a resample a
    Poisson number of times, whose mean is their number. So the work is resamples
    times distinct scores, however many rows have them, and what moves is a few
    numbers for each resample and range of scores.
    """
    counts = ranged(score_counts(df, score, label).filter("pos + neg > 0"))

    def draw(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        limits = lru_cache(maxsize=1024)(poisson_limits)
        block = block.sort_by("h")
        p, q, tp, fp = (np.zeros(n + 1, dtype=np.int64) for _ in range(4))
        u = np.zeros(n + 1)
        for h, pos, neg in zip(*(block.column(c).to_pylist() for c in ("h", "pos", "neg"))):
            a, b = (np.concatenate([[m], poisson_draws(seed, n, name, h, m, limits)]) for name, m in (("pos", pos), ("neg", neg)))
            u += a * (q + b * 0.5)
            p += a
            q += b
            if h >= theta:
                tp += a
                fp += b
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tolist()]) for x in (p, q, u, tp, fp))], ["score_range", "p", "q", "u", "tp", "fp"])

    ranges = counts.select("score_range", "h", "pos", "neg").groupBy("score_range").applyInArrow(draw, RESAMPLED)
    each = ranges.select("score_range", F.posexplode(F.arrays_zip("p", "q", "u", "tp", "fp")).alias("at", "x")).select("score_range", (F.col("at") - 1).alias("b"), "x.*")
    lower = Window.partitionBy("b").orderBy("score_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = each.withColumn("u", F.col("u") + F.col("p") * F.coalesce(F.sum("q").over(lower), F.lit(0)))
    return whole.groupBy("b").agg(*(F.sum(c).alias(c) for c in ("p", "q")), F.sum("u").alias("U"), *(F.sum(c).alias(c) for c in ("tp", "fp")))


def _interval(values: DataFrame, value: Column) -> DataFrame:
    """From resamples; none without three rows and two classes."""
    own, drawn, both = F.col("b") < 0, F.col("b") >= 0, (F.col("p") > 0) & (F.col("q") > 0)
    p = F.percentile(F.when(drawn & both, value), F.array(F.lit(0.025), F.lit(0.975)))
    out = values.agg(F.when(F.coalesce(F.max(F.when(own, both & (F.col("p") + F.col("q") >= 3))), F.lit(False)), p).alias("p"))
    return out.select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def bootstrap_auc(df: DataFrame, n: int, seed: int, score: str = "H", label: str = "y") -> DataFrame:
    """(lo, hi): 95 % interval of the AUC over resamples with both classes."""
    return _interval(bootstrap(df, n, seed, score, label), F.try_divide(F.col("U"), F.col("p") * F.col("q")))


def bootstrap_f1(df: DataFrame, theta: float, n: int, seed: int, score: str = "H", label: str = "y") -> DataFrame:
    """(lo, hi): 95 % interval of F1 at ``theta`` over resamples with both classes."""
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), F.lit(0.0))
    return _interval(bootstrap(df, n, seed, score, label, theta), f1)


def histogram(df: DataFrame, by: Sequence[str], bins: int = 20, score: str = "H") -> DataFrame:
    """(by.., bin, lo, hi, n, density): equal bins between a group's extremes,
    the last one closed; a group with one value spreads over one unit around it."""
    kept = df.filter(finite(score)).select(*by, F.col(score).cast("double").alias("h"))
    ends = kept.groupBy(*by).agg(F.min("h").alias("a"), F.max("h").alias("b"), F.count("*").alias("total"))
    flat = F.col("a") == F.col("b")
    ends = ends.withColumns({"a": F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")), "b": F.when(flat, F.col("b") + 0.5).otherwise(F.col("b"))})
    width = (F.col("b") - F.col("a")) / bins
    placed = kept.join(ends, list(by)).withColumn("bin", F.least(F.floor((F.col("h") - F.col("a")) / width).cast("int"), F.lit(bins - 1)))
    counts = placed.groupBy(*by, "bin", "a", "b", "total").agg(F.count("*").alias("n"))
    return counts.select(*by, "bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def rank_sum(df: DataFrame, score: str = "H", label: str = "y") -> DataFrame:
    """One row for the one-sided Mann-Whitney test that positives score higher:
    U, medians, counts, and ``ties``, the sum of t^3 - t over tied scores. All
    of it comes from the score counts, in one pass over the rows."""
    counts = ranged(score_counts(df, score, label))
    up = inside(()).rowsBetween(Window.unboundedPreceding, 0)
    middles = []
    for c in ("pos", "neg"):
        counts = counts.withColumn(f"{c}_up", F.col(f"{c}_before") + F.sum(c).over(up))
        lower, upper = (F.min(F.when((F.col(c) > 0) & (F.col(f"{c}_up") >= F.floor((F.col(f"{c}_all") + more) / 2)), F.col("h"))) for more in (1, 2))
        middles.append((lower * 0.5 + upper * 0.5).alias(f"median_{c}"))
    tied = F.col("pos") + F.col("neg")
    ties = F.coalesce(F.sum(F.pow(tied, 3) - tied), F.lit(0.0)).alias("ties")
    out = auc_of_counts(counts, (), *middles, ties)
    both = F.col("U").isNotNull()
    return out.select("n", "n_pos", "U", F.when(both, F.col("median_pos")).alias("median_pos"), F.when(both, F.col("median_neg")).alias("median_neg"), "ties")


def with_p(tests: DataFrame) -> DataFrame:
    """``tests``, rows of ``rank_sum``, with ``p_value``."""
    p = F.udf(lambda u, n, n_pos, ties: rank_sum_p(u, n_pos, n - n_pos, ties), "double")  # a row for each test
    return tests.withColumn("p_value", p("U", "n", "n_pos", "ties"))


#: Up to this size of the smaller class, scores without ties get an exact p-value.
EXACT_ROWS = 8
#: Up to so many pairs of the classes, which take about ten seconds.
EXACT_PAIRS = 5_000_000


def rank_sum_p(u: float | None, n_pos: int, n_neg: int, ties: float) -> float | None:
    """P(U or more) under no difference: exact for a class of ``EXACT_ROWS`` without ties, up to ``EXACT_PAIRS``,
    else normal with corrections for ties and continuity."""
    if u is None or not n_pos or not n_neg:
        return None
    few, many = sorted((n_pos, n_neg))
    if few <= EXACT_ROWS and not ties and few * many <= EXACT_PAIRS:
        # How many arrangements have each U: the coefficients of a product over i of (1 - q^(many + i)) / (1 - q^i).
        ways = np.zeros(few * many + 1, dtype=object)
        ways[0] = 1
        for i in range(1, few + 1):
            if many + i <= few * many:
                ways[many + i :] = ways[many + i :] - ways[: -(many + i)]
            for r in range(i):
                ways[r::i] = np.add.accumulate(ways[r::i])
        return int(ways[math.ceil(u) :].sum()) / math.comb(few + many, few)
    n = n_pos + n_neg
    spread = math.sqrt(n_pos * n_neg / 12 * ((n + 1) - ties / (n * (n - 1))))
    if spread == 0:
        return 1.0
    return 0.5 * math.erfc((u - n_pos * n_neg / 2 - 0.5) / spread / math.sqrt(2))


def graph_stats(df: DataFrame, group: str = "task") -> DataFrame:
    """Mean graph sizes and shares of degenerate answers, for each group and OVERALL."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("Vc", "Ec", "Va", "Ea")]
    return with_overall(df, group).groupBy(group).agg(F.count("*").alias("n"), *means, F.avg((F.col("Ea") == 0).cast("int")).alias("frac_empty_Ea"), F.avg(F.col("unscorable").cast("int")).alias("frac_unscorable"))


def degenerate_counts(df: DataFrame) -> DataFrame:
    """How many answers have no entities, no reference, no relations."""
    return df.agg(F.count("*").alias("n_test"), F.count_if("unscorable").alias("n_unscorable"), F.count_if("ref_empty").alias("n_ref_empty"), F.count_if(F.col("Ea") == 0).alias("n_empty_Ea"))


def set_metrics(gold: DataFrame, said: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n_gold, n_said, n_both, precision, recall, F1) of two sets of keys."""
    g, s = gold.select(*keys).distinct().withColumn("in_gold", F.lit(True)), said.select(*keys).distinct().withColumn("in_said", F.lit(True))
    on = [F.col(f"g.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = g.alias("g").join(s.alias("s"), on, "full")
    n = both.agg(F.count("in_gold").alias("n_gold"), F.count("in_said").alias("n_said"), F.count_if(F.col("in_gold").isNotNull() & F.col("in_said").isNotNull()).alias("n_both"))
    b = F.col("n_both").cast("double")
    return n.select("*", F.try_divide(b, F.col("n_said")).alias("precision"), F.try_divide(b, F.col("n_gold")).alias("recall"), F.try_divide(2 * b, F.col("n_gold") + F.col("n_said")).alias("F1"))


def conditional_agreement(gold: DataFrame, said: DataFrame, pair: Sequence[str], value: str) -> DataFrame:
    """(n_pairs, n_agree, agreement): of the distinct said triples whose pair is
    in gold, those whose value is one gold has for the pair."""
    s, g = said.select(*pair, value).distinct(), gold.select(*pair, value).distinct()
    known = s.join(g.select(*pair).distinct(), list(pair), "left_semi")
    agree = known.join(g.withColumn("yes", F.lit(1)), [*pair, value], "left")
    return agree.agg(F.count("*").alias("n_pairs"), F.count("yes").alias("n_agree")).select("*", F.try_divide(F.col("n_agree").cast("double"), F.col("n_pairs")).alias("agreement"))


def supported_share(relations: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(response_id, n, RP): relations whose verdict is ``entailed``, from a
    caller's table of verdicts. Documented by rule only; not a reproduction."""
    judged = relations.join(verdicts.select(*keys, "verdict"), list(keys), "left")
    return judged.groupBy("response_id").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("verdict") == "entailed", F.lit(False)).cast("int")).alias("RP"))


def worst_claims(verdicts: DataFrame, weights: dict[str, float], k: int = 3) -> DataFrame:
    """(response_id, risk): mean of each answer's ``k`` largest claim risks,
    with the caller's weight for each verdict. Not a reproduction."""
    weight = F.lit(None).cast("double")
    for verdict, w in weights.items():
        weight = F.when(F.col("verdict") == verdict, F.lit(float(w))).otherwise(weight)
    top = F.row_number().over(Window.partitionBy("response_id").orderBy(F.desc("w")))
    return verdicts.select("response_id", weight.alias("w")).filter("w is not null").withColumn("r", top).filter(F.col("r") <= k).groupBy("response_id").agg(F.avg("w").alias("risk"))


def critical_risk(scores: DataFrame, risks: DataFrame, beta: float = 0.5) -> DataFrame:
    """(response_id, H): (1 - beta) * (1 - EG) + beta * worst-claim risk. Not a reproduction."""
    return scores.join(risks, "response_id", "left").select("response_id", ((1 - beta) * (1 - F.col("EG")) + beta * F.col("risk")).alias("H"))
