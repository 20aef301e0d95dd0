import itertools
import math
import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import stats
from plumbline.plans import tune


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, k string, H double, y int")


def pair_auc(rows):
    pos, neg = [h for _, _, h, y in rows if y and h is not None], [h for _, _, h, y in rows if not y and h is not None]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def scan_theta(rows):
    kept = [(h, y) for _, _, h, y in rows if h is not None]
    values = sorted({h for h, _ in kept})
    if len({y for _, y in kept}) < 2:
        return 0.5, None
    best = (0.5, -1.0)
    for t in sorted({values[0] - 1e-9, *values, *((a + b) / 2 for a, b in zip(values, values[1:]))}):
        tp = sum(y for h, y in kept if h >= t)
        f1 = 2 * tp / (sum(h >= t for h, _ in kept) + sum(y for _, y in kept)) if tp else 0.0
        if f1 > best[1]:
            best = (t, f1)
    return best


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(f"g{i % 5}", str(i), None if rng.random() < 0.1 else rng.randint(0, 6) / 7, int(rng.random() < 0.4) if i % 5 else 0) for i in range(200)]


def test_auc_is_pair_counting(spark, rows):
    got = {r.g: r.AUC for r in stats.auc_breakdown(frame(spark, rows), "g").collect()}
    for g in got:
        expected = pair_auc([r for r in rows if g in (r[0], "OVERALL")])
        assert got[g] == (None if expected is None else pytest.approx(expected))
    assert got["g0"] is None  # one class


def test_auc_mirrors(spark, rows):
    df = frame(spark, rows)
    assert stats.auc(df).first().AUC == pytest.approx(1 - stats.auc(df.selectExpr("-H AS H", "y")).first().AUC)


def test_threshold_is_the_scan(spark, rows):
    got = {r.g: (r.theta, r.F1) for r in stats.best_threshold(frame(spark, rows), by=["g"]).collect()}
    for g in got:
        theta, f1 = scan_theta([r for r in rows if r[0] == g])
        assert got[g] == (pytest.approx(theta), None if f1 is None else pytest.approx(f1))


def test_empty_and_undefined_columns(spark):
    for data in ([], [("g", "1", None, 1), ("g", "2", float("nan"), 0)]):
        df = frame(spark, data)
        assert tuple(stats.auc(df).first())[:2] == (0, 0) and stats.auc(df).first().AUC is None
        assert stats.best_threshold(df).count() in (0, 1)
        prf = stats.precision_recall(df, 0.5).first()
        assert prf.n == 0 and prf.F1 is None
        assert stats.bootstrap_auc(df, 5, 1).first().lo is None


def test_rank_sum_p_values():
    # all 6 arrangements of 2 of 4: U = 4 is the single best
    assert stats.rank_sum_p(4, 2, 2, 0) == pytest.approx(1 / 6)
    assert stats.rank_sum_p(0, 2, 2, 0) == pytest.approx(1.0)
    # near the normal law for larger samples
    mean, sd = 50 * 60 / 2, math.sqrt(50 * 60 * 111 / 12)
    assert stats.rank_sum_p(mean + 1.96 * sd, 50, 60, 0) == pytest.approx(0.025, abs=5e-4)
    assert stats.rank_sum_p(None, 0, 3, 0) is None


def test_exact_p_values_have_no_limit_that_matters():
    assert stats.rank_sum_p(8 * 1251 / 2, 8, 1251, 0) == pytest.approx(0.5, abs=1e-3)
    for a, b in ((2, 3), (3, 2), (4, 4), (1, 6)):
        us = [sum(p > q for p in c for q in set(range(a + b)) - set(c)) for c in itertools.combinations(range(a + b), a)]
        assert [stats.rank_sum_p(float(u), a, b, 0) for u in range(a * b + 1)] == pytest.approx([sum(x >= u for x in us) / len(us) for u in range(a * b + 1)])


def test_rank_sum_is_one_pass_over_counts(spark, rows):
    got = stats.with_p(stats.rank_sum(frame(spark, rows))).first()
    pos, neg = ([h for _, _, h, y in rows if h is not None and y == c] for c in (1, 0))
    assert (got.n, got.n_pos) == (len(pos) + len(neg), len(pos))
    assert (got.median_pos, got.median_neg) == (pytest.approx(statistics.median(pos)), pytest.approx(statistics.median(neg)))
    sizes = [(pos + neg).count(h) for h in set(pos + neg)]
    assert got.ties == sum(t**3 - t for t in sizes)
    assert got.U == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg))
    assert got.p_value == pytest.approx(stats.rank_sum_p(got.U, len(pos), len(neg), got.ties))
    none = stats.with_p(stats.rank_sum(frame(spark, [("g", "1", 0.5, 1)]))).first()
    assert none.U is None and none.p_value is None and none.median_pos is None


def test_p_value_is_the_share_of_arrangements(spark):
    scores = [0.9, 0.1, 0.7, 0.3, 0.5, 0.8]
    df = frame(spark, [("g", str(i), h, int(i < 3)) for i, h in enumerate(scores)])
    u = [sum(scores[i] > scores[j] for i in c for j in range(6) if j not in c) for c in itertools.combinations(range(6), 3)]
    assert stats.with_p(stats.rank_sum(df)).first().p_value == pytest.approx(sum(x >= u[0] for x in u) / len(u))


def test_lengths_and_breakdowns_keep_groups_without_a_score(spark):
    df = spark.createDataFrame([(5, 0.5, 1), (6, 0.1, 0), (15, None, 1), (99, 0.5, 0)], "context_len int, H double, y int")
    got = {r.bucket: (r.mean_len, r.n, r.n_pos, r.AUC) for r in stats.length_buckets(df, (0, 10, 20, 30)).collect()}
    assert got == {"[0,10)": (5.5, 2, 1, 1.0), "[10,20)": (15.0, 0, 0, None)}
    found = {r.score: (r.n, r.AUC) for r in stats.ablation(df.withColumn("none", F.lit(None).cast("double")), {"H": "H", "none": "none"}).collect()}
    assert found["none"] == (0, None) and found["H"][0] == 3


def test_numbers_are_those_of_one_window(spark, rows):
    df = frame(spark, rows)
    order = Window.partitionBy("y").orderBy(stats.hash_order(F.col("k"), 7), "k")
    plain = {r.k: r.r for r in df.withColumn("r", F.row_number().over(order) - 1).collect()}
    got = stats.numbered(df, "k", 7, "y").collect()
    assert {r.k: r.r for r in got} == plain and len(got) == len(rows)
    assert {r.least for r in got} == {min(sum(y == c for *_, y in rows) for c in (0, 1))}
    assert stats.numbered(df.limit(0), "k", 7, "y").count() == 0


def test_resamples_are_poisson(spark, rows):
    df = frame(spark, rows)
    sums = stats.bootstrap(df, 200, 1, theta=0.5).withColumn("n", F.col("p") + F.col("q")).collect()
    real = sum(h is not None for _, _, h, _ in rows)
    drawn = [r.n for r in sums if r.b >= 0]
    assert len(drawn) == 200 and [r.n for r in sums if r.b < 0] == [real]
    assert abs(statistics.mean(drawn) - real) < 4 * math.sqrt(real / 200) and 0.7 * real < statistics.variance(drawn) < 1.35 * real
    lo, hi = stats.bootstrap_f1(df, 0.5, 100, 42).first()
    assert lo < stats.precision_recall(df, 0.5).first().F1 < hi
    assert stats.bootstrap_auc(df.filter("y = 1"), 20, 1).first().lo is None
    assert stats.bootstrap_auc(df.filter("H is not null").limit(2), 20, 1).first().lo is None


def test_draws_are_by_inverse_distribution():
    for mean in (1, 2, 9, 300, 100_000):
        first, limits = stats.poisson_limits(mean)
        chances = np.diff(np.concatenate([[0], limits.astype(float)])) / 2**32
        k = first + np.arange(len(chances))
        assert (chances * k).sum() == pytest.approx(mean, rel=1e-6) and (chances * (k - mean) ** 2).sum() == pytest.approx(mean, rel=1e-5)
        exact = [math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in (mean, mean + 1)]
        assert [chances[i - first] for i in (mean, mean + 1)] == pytest.approx(exact, abs=1e-9)
        drawn = stats.poisson_draws(1, 2000, "pos", 0.25, mean)
        assert abs(drawn.mean() - mean) < 5 * math.sqrt(mean / 2000)
    assert stats.poisson_draws(1, 5, "pos", 0.5, 0).tolist() == [0] * 5


def test_resampled_ranks_are_those_of_the_drawn_counts(spark):
    rng = random.Random(5)
    rows = [("g", str(i), rng.randint(0, 400) / 7, int(rng.random() < 0.4)) for i in range(900)]
    counts = {}
    for _, _, h, y in rows:
        counts.setdefault(h, [0, 0])[y] += 1
    drawn = {h: [stats.poisson_draws(3, 6, name, h, n) for n, name in zip(both, ("neg", "pos"))] for h, both in counts.items()}
    got = {r.b: r for r in stats.bootstrap(frame(spark, rows), 6, 3, theta=30.0).collect()}
    for b in range(-1, 6):
        each = {h: [n if b < 0 else int(d[b]) for n, d in zip(both, drawn[h])] for h, both in counts.items()}
        u = sum(each[h][1] * (sum(each[x][0] for x in each if x < h) + each[h][0] / 2) for h in each)
        expected = (sum(e[1] for e in each.values()), sum(e[0] for e in each.values()), u, sum(each[h][1] for h in each if h >= 30), sum(each[h][0] for h in each if h >= 30))
        assert (got[b].p, got[b].q, got[b].U, got[b].tp, got[b].fp) == pytest.approx(expected)


def test_work_of_resamples_does_not_follow_the_rows(spark):
    few = frame(spark, [("g", str(i), i % 20 / 20, i % 2) for i in range(400)])
    many = spark.range(2_000_000).selectExpr("'g' AS g", "'' AS k", "(id % 20) / 20 AS H", "cast((id % 40) >= 20 AS int) AS y")
    took = {}
    for name, df in (("few", few), ("few", few), ("many", many)):
        began = time.monotonic()
        lo, hi = stats.bootstrap_auc(df, 300, 1).first()
        took[name] = time.monotonic() - began
    assert lo < stats.auc(many).first().AUC < hi and hi - lo < 0.01
    assert took["many"] < 3 * took["few"] + 3


def test_continuous_scores_are_no_single_task(spark):
    """Scores that are all different, one group with nearly all of them, and one without any."""
    df = spark.range(300_000).selectExpr("CASE WHEN id % 100 = 0 THEN 'rare' WHEN id % 100 = 1 THEN 'none' ELSE 'hot' END AS g", "CASE WHEN id % 100 <> 1 THEN sin(id) END AS H", "cast(cos(id * 7) + sin(id) / 3 > 0.2 AS int) AS y")
    ranges = stats.ranged(stats.score_counts(df, "H", "y", ["g"]), ["g"]).groupBy("g", "score_range").count().collect()
    assert max(r["count"] for r in ranges if r.score_range >= 0) < 300_000 / 50
    got = {r.g: r.AUC for r in stats.auc_breakdown(df, "g").collect()}
    table = df.toPandas()
    for g in ("hot", "rare", "OVERALL"):
        own = table if g == "OVERALL" else table[table.g == g]
        own = own[own.H.notna()]
        ranks = own.H.rank()
        p = int(own.y.sum())
        assert got[g] == pytest.approx((ranks[own.y == 1].sum() - p * (p + 1) / 2) / (p * (len(own) - p)))
    assert got["none"] is None


def test_folds_are_stratified_and_sample_is_exact(spark, rows):
    df = frame(spark, rows)
    sizes = [r["count"] for r in stats.stratified_folds(df, "k", 4, 7).groupBy("y", "fold").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 200 // 4
    assert stats.sample(df, "k", 30, 1).count() == 30 and stats.sample(df, "k", 999, 1).count() == 200


def test_bootstrap_interval_holds_the_estimate(spark, rows):
    df = frame(spark, rows)
    lo, hi = stats.bootstrap_auc(df, 100, 42).first()
    assert lo < stats.auc(df).first().AUC < hi


def test_tuning_reads_train_only(spark):
    rng = random.Random(5)
    base = [(str(i), "train" if i % 2 else "test", i // 2 % 2, rng.random(), rng.random() if i % 3 else None, False) for i in range(80)]
    poisoned = [(k, s, 1 if s == "test" else y, 0.0 if s == "test" else eg, rp, u) for k, s, y, eg, rp, u in base]
    schema = "response_id string, split string, y int, EG double, RP double, unscorable boolean"
    a, b = (spark.createDataFrame(x, schema) for x in (base, poisoned))
    assert sorted(tune.alpha_grid(a).collect()) == sorted(tune.alpha_grid(b).collect())
    assert tune.theta(a, 0.7).collect() == tune.theta(b, 0.7).collect()
    none = spark.createDataFrame([], schema)
    assert tune.best_alpha(tune.alpha_grid(none)).first().alpha == 0.5


def test_set_metrics(spark):
    gold = spark.createDataFrame([("a", "b"), ("c", "d")], "x string, y string")
    said = spark.createDataFrame([("a", "b"), ("c", "e"), ("c", "e")], "x string, y string")
    got = stats.set_metrics(gold, said, ["x", "y"]).first()
    assert (got.n_gold, got.n_said, got.n_both, got.F1) == (2, 2, 1, 0.5)
    assert stats.conditional_agreement(gold, said, ["x"], "y").first().agreement == 0.5
