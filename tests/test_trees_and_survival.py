"""Boosted trees, survival forest and log-normal regression against brute force and known answers."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fieldpulse.models import boosting, lifetime, survival_trees
from fieldpulse.models.acute import predict_acute, train_acute
from fieldpulse.models.boosting import MISSING, BoostedTrees, best_split, train_boosted
from fieldpulse.models.lifetime import LogNormalLifetime, train_lifetime
from fieldpulse.models.survival_trees import SurvivalForest, train_forest
from fieldpulse.operators.metrics import roc_auc
from fieldpulse.operators.survival import c_index, event_residual

# boosted trees ----------------------------------------------------------------------------------------------------------

NAMES = ["a", "b", "c", "gap", "empty"]


def planted(spark, n, seed):
    """A label that depends on two columns together and on whether a third is missing."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    missing = rng.random(n) < 0.3
    risk = 1.2 * np.where(x[:, 0] > 0, x[:, 1], -x[:, 1]) + 0.8 * np.sin(2 * x[:, 2]) + 1.2 * missing - 2.2
    y = (rng.random(n) < 1 / (1 + np.exp(-risk))).astype(int)
    rows = [(*map(float, r[:3]), None if m else float(r[3]), None, int(k)) for r, m, k in zip(x, missing, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, gap double, empty double, y int").repartition(3).cache()


def area(scored):
    return scored.transform(lambda d: roc_auc(d)).first()["roc_auc"]


def test_patience_keeps_many_trees_and_beats_a_single_one(spark):
    train, val, test = (planted(spark, n, s) for n, s in ((6000, 1), (3000, 2), (3000, 3)))
    model = train_acute(train, val, NAMES, rounds=120, step=0.1, patience=20)
    assert len(model.trees) > 20 and len(model.gains) <= 120 and max(model.gains) == model.gains[len(model.trees) - 1]
    # what training kept before there was patience: one tree, medians and flags instead of a side for missing values
    def filled(df):
        flags = [F.col(c).isNull().cast("double").alias(f"m_{c}") for c in NAMES[:4]]
        return VectorAssembler(inputCols=[*NAMES[:4], *[f"m_{c}" for c in NAMES[:4]]], outputCol="x").transform(
            df.select("y", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in NAMES[:4]], *flags)).withColumn("label", F.col("y").cast("double"))
    single = GBTClassifier(featuresCol="x", labelCol="label", maxIter=1, maxDepth=4, seed=42).fit(filled(train))
    old = area(single.transform(filled(test)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))))
    assert area(predict_acute(model, test)) >= old + 0.02


def test_trees_do_not_depend_on_the_tasks(spark):
    train, val = planted(spark, 1500, 4), planted(spark, 500, 5)
    def grown(parts):
        model = train_boosted(train.coalesce(1).repartitionByRange(parts, "a"), val, NAMES, rounds=3, sample=1.0, depth=3)
        return [(t.feature.tolist(), t.threshold.tolist(), t.missing_left.tolist(), t.value.tolist()) for t in model.trees], model.gains
    assert grown(1) == grown(4)


def brute_split(values, g, h, ridge, least):
    """Every threshold between two values and both sides for the missing ones, of one column."""
    best, known = None, ~np.isnan(values)

    def quality(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + ridge)
    for t in [*np.unique(values[known])[1:], np.inf]:
        for missing_left in (False, True):
            left = np.where(known, values < t, missing_left)
            if min(h[left].sum(), h[~left].sum()) < least:
                continue
            gain = quality(left) + quality(~left) - g.sum() ** 2 / (h.sum() + ridge)
            if gain > 1e-6 and (best is None or gain > best + 1e-9):
                best = gain
    return best


def test_best_split_matches_every_threshold():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, wide = 80, rng.integers(2, 12)
        values = rng.integers(0, wide, n).astype(float)
        values[rng.random(n) < 0.25] = np.nan
        g, h = rng.normal(size=n) + np.nan_to_num(values, nan=3.0) / 4 - 1, rng.random(n) + 0.1
        cuts = [list(np.unique(values[~np.isnan(values)])[1:])]
        bins = boosting.to_bins(values[:, None], cuts)[:, 0]
        sums = np.stack([np.bincount(bins, w, 256) for w in (g, h)])[None]
        split = best_split(sums, np.array([0]), [len(cuts[0])], 1.0, 2.0)
        wanted = brute_split(values, g, h, 1.0, 2.0)
        assert (split is None) == (wanted is None) and (split is None or math.isclose(split.gain, wanted, rel_tol=1e-9))


def test_missing_values_take_the_learned_side(spark):
    rows = [(None if i % 4 == 0 else float(i % 50), int(i % 4 == 0 or i % 50 > 40)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "x double, y int")
    model = train_boosted(frame, frame, ["x"], rounds=1, depth=1, sample=1.0, step=1.0)
    tree = model.trees[0]
    assert tree.feature[0] == 0 and not tree.missing_left[0] and tree.threshold[0] > 35
    scored = model.transform(spark.createDataFrame([(None,), (float("nan"),), (0.0,), (49.0,)], "x double")).collect()
    assert scored[0]["score"] == scored[1]["score"] == scored[3]["score"] > 0.5 > scored[2]["score"]


def test_binned_and_raw_values_reach_the_same_leaves():
    rng = np.random.default_rng(3)
    cuts = [sorted(rng.normal(size=6).tolist()) for _ in range(3)]
    values = rng.normal(size=(500, 3))
    values[rng.random((500, 3)) < 0.2] = np.nan
    values[0], values[1] = [c[2] for c in cuts], [np.inf] * 3
    bins, tree = boosting.to_bins(values, cuts), boosting.Tree.empty(3)
    for i in range(7):
        tree.feature[i], tree.cut[i] = rng.integers(3), rng.integers(7)
        edges = cuts[tree.feature[i]]
        tree.threshold[i] = edges[tree.cut[i]] if tree.cut[i] < 6 else np.inf
        tree.missing_left[i] = rng.random() < 0.5
    assert (bins == MISSING).any()
    assert tree.leaves(boosting.binned_side(tree, bins)).tolist() == tree.leaves(boosting.value_side(tree, values)).tolist()
    assert boosting.binned_leaves(tree, np.ascontiguousarray(bins.T)).tolist() == tree.leaves(boosting.binned_side(tree, bins)).tolist()


def test_training_without_use_or_gain(spark):
    train = planted(spark, 300, 6)
    nothing = train_boosted(train, train, ["empty"], rounds=5)
    assert nothing.trees == [] and nothing.transform(train).first()["score"] == 0.5
    noise = train.withColumn("y", (F.xxhash64("a") % 2 == 0).cast("int"))
    stopped = train_boosted(noise, noise.limit(0), NAMES, rounds=40, patience=3)
    assert len(stopped.gains) <= 4  # without validation days there is nothing to gain


def test_boosted_trees_are_stored_whole(spark, tmp_path):
    train = planted(spark, 800, 7)
    model = train_boosted(train, train, NAMES, rounds=4, depth=2)
    model.save(f"{tmp_path}/m")
    again = BoostedTrees.load(f"{tmp_path}/m")
    assert again.columns == model.columns and again.gains == model.gains and len(again.trees) == len(model.trees)
    both = model.transform(train).withColumnRenamed("score", "one")
    assert again.transform(both).where("one <> score").isEmpty()


# survival forest --------------------------------------------------------------------------------------------------------


def naive_log_rank(time, event, left):
    gap = spread = 0.0
    for t in np.unique(time[event == 1]):
        n, n1 = (time >= t).sum(), (left & (time >= t)).sum()
        d, d1 = ((time == t) & (event == 1)).sum(), ((time == t) & (event == 1) & left).sum()
        gap += d1 - d * n1 / n
        spread += d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) if n > 1 else 0
    return gap * gap / spread if spread > 0 else 0.0


def test_log_rank_of_all_cuts_matches_the_sum_over_days():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 60
        x, time, event = rng.integers(0, 6, n), rng.integers(1, 15, n), (rng.random(n) < 0.6).astype(float)
        place = (x, np.searchsorted(np.unique(time), time))
        deaths, rows = np.zeros((6, len(np.unique(time)))), np.zeros((6, len(np.unique(time))))
        np.add.at(deaths, place, event)
        np.add.at(rows, place, 1)
        found = survival_trees.log_rank(deaths, rows, 3)
        for cut in range(5):
            left = x <= cut
            wanted = naive_log_rank(time, event, left) if min(left.sum(), (~left).sum()) >= 3 else 0.0
            assert math.isclose(found[cut], wanted, rel_tol=1e-9, abs_tol=1e-9)


def lasting(spark, n, seed):
    """Objects whose hazard depends on two columns together; two in five are censored."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    hazard = np.exp(1.3 * np.where(x[:, 0] > 0, x[:, 1], -x[:, 1]))
    failed = rng.exponential(120 / hazard)
    seen = rng.exponential(220, n)
    rows = [(f"o{seed}-{i}", float(max(1, round(min(f, s)))), int(f <= s), *map(float, r)) for i, (f, s, r) in enumerate(zip(failed, seen, x))]
    return spark.createDataFrame(rows, "object_id string, duration double, event int, a double, b double, c double, d double").cache()


def test_forest_orders_held_out_objects_at_least_as_well_as_residuals(spark):
    from pyspark.ml.regression import RandomForestRegressor
    train, test = lasting(spark, 900, 1), lasting(spark, 600, 2)
    columns = ["a", "b", "c", "d"]
    model = train_forest(train, columns, trees=60, leaf=15)
    own = c_index(model.transform(test), "chronic_score").first()["c_index"]
    vectors = VectorAssembler(inputCols=columns, outputCol="x")
    residuals = RandomForestRegressor(featuresCol="x", labelCol="residual", predictionCol="score", numTrees=60, minInstancesPerNode=15,
                                      featureSubsetStrategy="sqrt", seed=42).fit(vectors.transform(event_residual(train)))
    other = c_index(residuals.transform(vectors.transform(test)).select("duration", "event", "score")).first()["c_index"]
    assert own >= other and own > 0.62


def test_forest_is_repeatable_bounded_and_stored(spark, tmp_path):
    train = lasting(spark, 300, 3).withColumn("b", F.when(F.col("c") > -0.5, F.col("b"))).withColumn("none", F.lit(None).cast("double"))
    def scores(model):
        return sorted((r["object_id"], r["chronic_score"]) for r in model.transform(train).collect())
    model = train_forest(train, ["a", "b", "none"], trees=8, leaf=10)
    assert model.columns == ["a", "b"]
    assert scores(model) == scores(train_forest(train.repartition(5), ["a", "b", "none"], trees=8, leaf=10))
    model.save(f"{tmp_path}/f")
    assert scores(SurvivalForest.load(f"{tmp_path}/f")) == scores(model)
    small = train_forest(train, ["a", "b"], trees=8, leaf=10, tree_rows=60)
    assert all(len(t["feature"]) <= 2 * 100 // 10 for t in small.trees)
    assert {s for _, s in scores(train_forest(train, ["none"], trees=3))} == {0.0}


def test_leaves_hold_the_hazard_of_their_objects():
    time, event = np.array([0, 1, 1, 2, 3, 3]), np.array([0.0, 1, 0, 1, 1, 0])
    deaths, rows = np.bincount(time, event, 4), np.bincount(time, minlength=4)
    steps = np.cumsum([0, 1 / 5, 1 / 3, 1 / 2])
    assert math.isclose(survival_trees.mortality(deaths, rows, np.array([0.0, 1, 1, 1])), steps[1:].sum())


# log-normal regression --------------------------------------------------------------------------------------------------


def durations(spark, n, seed, censored=True):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(10, 3, n), rng.normal(0, 0.2, n)])
    log = 2.0 + 0.15 * x[:, 0] - 1.5 * x[:, 1] + 0.7 * rng.normal(size=n)
    end = rng.normal(4.0, 0.6, n) if censored else np.full(n, 99.0)
    rows = [(float(np.exp(min(l, e))), int(l <= e), float(a), float(b)) for l, e, (a, b) in zip(log, end, x)]
    frame = spark.createDataFrame(rows, "duration double, event int, a double, b double")
    return frame, x, np.minimum(log, end), log <= end


def test_derivatives_match_differences():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(40), rng.normal(size=(40, 2))])
    y, event, at = rng.normal(size=40), rng.random(40) < 0.5, np.array([0.2, -0.4, 0.3, -0.2])
    _, gradient, hessian = lifetime.derivatives(x, y, event, at)
    for k in range(4):
        step = np.zeros(4)
        step[k] = 1e-5
        (up, gu, _), (down, gd, _) = (lifetime.derivatives(x, y, event, at + s * step) for s in (1, -1))
        assert math.isclose(gradient[k], (up - down) / 2e-5, rel_tol=1e-6, abs_tol=1e-6)
        assert np.allclose(hessian[k], (gu - gd) / 2e-5, rtol=1e-5, atol=1e-5)


def test_tail_of_the_normal_distribution_far_out():
    z = np.array([-40.0, -3.0, 0.0, 5.0, 24.9, 25.1, 60.0])
    found = lifetime.log_tail(z)
    assert np.allclose(found[:5], [math.log(0.5 * math.erfc(v / math.sqrt(2))) for v in z[:5]])
    assert abs(found[5] - found[4] + (25.1**2 - 24.9**2) / 2 + math.log(25.1 / 24.9)) < 1e-4 and found[6] < -1800


def test_without_censoring_and_ridge_the_fit_is_least_squares(spark):
    frame, x, log, _ = durations(spark, 400, 3, censored=False)
    model = train_lifetime(frame, ["a", "b"], ridge=0.0)
    full = np.column_stack([np.ones(400), x])
    wanted = np.linalg.lstsq(full, log, rcond=None)[0]
    assert np.allclose([model.intercept, *model.coefficients], wanted, atol=1e-6)
    assert math.isclose(model.sigma, math.sqrt(np.mean((log - full @ wanted) ** 2)), rel_tol=1e-6)


def test_censored_fit_with_ridge_is_the_maximum(spark):
    frame, x, log, event = durations(spark, 800, 4)
    model = train_lifetime(frame.repartition(3), ["a", "b"])
    spread = x.std(axis=0, ddof=1)

    def objective(p):
        """Mean log-likelihood less the ridge, term by term."""
        total = 0.0
        for row, y, e in zip(x, log, event):
            z = (y - p[0] - (row / spread) @ p[1:3]) / math.exp(p[3])
            total += -p[3] - z * z / 2 - 0.5 * math.log(2 * math.pi) if e else math.log(0.5 * math.erfc(z / math.sqrt(2)))
        return total / len(log) - 0.05 * (p[1] ** 2 + p[2] ** 2)

    found = np.array([model.intercept, *(np.array(model.coefficients) * spread), math.log(model.sigma)])
    best = objective(found)
    rng = np.random.default_rng(5)
    for scale in (0.1, 0.01, 0.001):
        assert all(objective(found + scale * rng.normal(size=4)) < best for _ in range(15))
    free = train_lifetime(frame, ["a", "b"], ridge=0.0)
    assert np.allclose([*free.coefficients, free.sigma], [0.15, -1.5, 0.7], atol=0.25)


def test_lifetimes_fill_gaps_and_are_stored(spark, tmp_path):
    frame = durations(spark, 200, 6)[0].withColumn("flat", F.lit(1.0)).withColumn("a", F.when(F.col("b") > -0.2, F.col("a")))
    model = train_lifetime(frame, ["a", "b", "flat", "unknown"])
    assert model.columns == ["a", "b"]
    model.save(f"{tmp_path}/l")
    days = LogNormalLifetime.load(f"{tmp_path}/l").transform(frame)
    assert days.where("aft_median_days > 0").count() == 200
    row = days.where("a IS NULL").first()
    assert math.isclose(row["aft_median_days"], math.exp(model.intercept + model.coefficients[0] * model.medians[0] + model.coefficients[1] * row["b"]))
    with pytest.raises(ValueError, match="failed"):
        train_lifetime(frame.withColumn("event", F.lit(0)), ["a"])


def test_blocks_are_dealt_to_all_cores(spark):
    rows = spark.range(100000, numPartitions=1).selectExpr("cast(id % 97 as double) AS a", "cast(id % 2 as int) AS y")
    blocks = boosting.binned_blocks(rows, rows.limit(0), ["a"], [[10.0, 50.0]], "y")
    assert blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert blocks.agg({"n": "sum"}).first()[0] == 100000


def test_passes_sum_the_lighter_children_only(spark, monkeypatch):
    """What is left of a parent is its other child, to the last bit: the tree is that of summing all nodes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + x[:, 1] * (x[:, 0] > 0) + 0.5 * rng.normal(size=3000) > 0.8).astype(int)
    rows = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y)], "a double, b double, c double, y int")
    cuts = boosting.quantile_cuts(rows, ["a", "b", "c"])
    blocks = boosting.binned_blocks(rows, rows.limit(0), ["a", "b", "c"], cuts, "y")
    asked, sums = [], boosting._Trainer.sums

    def seen(self, job):
        asked.append(job.wanted)
        return sums(self, job)

    def whole(self, job):
        job.wanted[:] = True
        return sums(self, job)

    def grown(how):
        monkeypatch.setattr(boosting._Trainer, "sums", how)
        return boosting._Trainer(blocks, cuts, 2.0, 3, 0.1, 0.8, 1.0, 5.0, 1.0, 7).grow(0)[0]

    tree, full = grown(seen), grown(whole)
    assert all((a == b).all() for a, b in zip(vars(tree).values(), vars(full).values()))
    assert [len(w) for w in asked] == [1, 2, 4] and asked[1].sum() == 1 and asked[2].sum() == 2
