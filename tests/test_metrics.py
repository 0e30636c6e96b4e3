import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import scored
from fieldpulse.operators import metrics as M
from fieldpulse.operators import resampling as B
from fieldpulse.operators import survival as C


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for o in range(40):
        for d in range(60):
            fails = o % 4 == 0
            ttf = (60 - d) * 24.0 if fails else None
            out.append((f"o{o}", d, round(float(rng.random() + (0.4 if fails and d > 35 else 0)), 2), ttf))
    return out


@pytest.fixture(scope="module")
def panel(spark, rows):
    return scored(spark, rows).repartition(6).cache()


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))


def arrays(rows):
    y = np.array([r[3] is not None and r[3] <= 720 for r in rows]).astype(int)
    return y, np.array([r[2] for r in rows])


def test_discrimination(panel, rows):
    got = M.discrimination(panel).first()
    y, s = arrays(rows)
    assert got["roc_auc"] == pytest.approx(auc(y, s)) and got["base_rate"] == pytest.approx(y.mean())
    steps = sorted(set(s), reverse=True)
    recall = [0] + [y[s >= t].sum() / y.sum() for t in steps]
    precision = [y[s >= t].mean() for t in steps]
    assert got["pr_auc"] == pytest.approx(sum((recall[i + 1] - recall[i]) * p for i, p in enumerate(precision)))


def test_one_class_has_no_ranking(spark):
    got = M.discrimination(scored(spark, [("a", 0, .1), ("a", 1, .2)])).first()
    assert (got["roc_auc"], got["pr_auc"], got["base_rate"]) == (None, None, 0.0)


def test_budget_threshold(panel, rows):
    assert M.budget_threshold(panel, 0.02).first()["threshold"] == pytest.approx(np.quantile([r[2] for r in rows], 0.98))


def test_class_weight(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (0,)], "y int")
    assert M.class_weight(df).first()["weight"] == 3.0
    assert M.class_weight(df.where("y = 0")).first()["weight"] == 3.0


def test_detection_next_to_its_floor(panel, rows):
    thr = 1.1
    got = M.detection(panel, thr).first()
    fails = [f"o{o}" for o in range(0, 40, 4)]
    fired = {o: [r[3] / 24 for r in rows if r[0] == o and r[2] >= thr and 0 < r[3] <= 1440] for o in fails}
    share = np.mean([r[2] >= thr for r in rows])
    assert (got["fail_objects"], got["detected"]) == (10, sum(bool(v) for v in fired.values()))
    assert got["detection_null"] == pytest.approx(1 - (1 - share) ** 60)
    assert got["detection_lift"] == pytest.approx(got["detection"] - got["detection_null"])
    assert got["lead_median"] == pytest.approx(np.median([max(v) for v in fired.values() if v]))
    assert got["opp_median"] == 60 and got["alerts_per_day"] == pytest.approx(sum(r[2] >= thr for r in rows) / 60)


def test_nothing_fails(spark):
    got = M.detection(scored(spark, [("a", 0, .5)]), 0.1).first()
    assert (got["fail_objects"], got["detected"], got["detection"]) == (0, 0, None)


def test_permutation_floor_is_the_hypergeometric_one(panel, rows):
    thr = 1.1
    n, k = len(rows), sum(r[2] >= thr for r in rows)
    chance = 1.0
    for i in range(60):  # no alert among an object's sixty rows, drawn without replacement
        chance *= (n - k - i) / (n - i)
    got = B.permutation_null(panel, thr, replicates=400, seed=1).first()
    assert got["null_mean"] == pytest.approx(1 - chance, abs=0.03) and got["B"] == 400
    assert got["null_lo"] < got["null_mean"] < got["null_hi"]
    assert got["lift"] == pytest.approx(M.detection(panel, thr).first()["detection"] - got["null_mean"])
    again = B.permutation_null(panel, thr, replicates=400, seed=1).first()
    assert tuple(got) == tuple(again)


def test_permutation_over_many_slices(monkeypatch, panel):
    whole = B.permutation_null(panel, 1.1, replicates=300, seed=2).first()
    monkeypatch.setattr(B, "SLICE_OBJECTS", 3)
    cut = B.permutation_null(panel, 1.1, replicates=300, seed=3).first()
    assert cut["null_mean"] == pytest.approx(whole["null_mean"], abs=0.03)


def test_detection_interval(panel):
    real = M.detection(panel, 1.2).first()
    got = B.bootstrap_detection(panel, 1.2, 500, 0).first()
    assert got["detection_lo"] <= real["detection"] <= got["detection_hi"]
    spread = 1.96 * (real["detection"] * (1 - real["detection"]) / 10) ** 0.5
    assert got["detection_hi"] - got["detection_lo"] == pytest.approx(2 * spread, abs=0.12)


def weights_of(panel, replicates, seed):
    rows = sorted(B.object_weights(panel, replicates, seed).collect(), key=lambda r: r["chunk"])
    return {o: [w for r in rows if r["object_id"] == o for w in r["weights"]] for o in {r["object_id"] for r in rows}}


def test_roc_draws_against_weighted_brute_force(panel, rows):
    weights = weights_of(panel, 5, 9)
    assert all(sum(w[b] for w in weights.values()) == 40 for b in range(5))
    draws = {r["replicate"]: r["roc_auc"] for r in B.bootstrap_roc_draws(panel, 30, 5, 9, parts=16, multinomial=True).collect()}
    y, s = arrays(rows)
    for b, value in draws.items():
        repeat = np.array([weights[r[0]][b] for r in rows])
        assert value == pytest.approx(auc(np.repeat(y, repeat), np.repeat(s, repeat)))


@pytest.mark.parametrize("parts", [2, 16])
def test_hashed_draws_against_weighted_brute_force(panel, rows, parts, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 2)
    hashes = {r[0]: r[1] for r in panel.select("object_id", F.xxhash64("object_id")).distinct().collect()}
    weights = dict(zip(hashes, B.poisson_weights(np.array(list(hashes.values())), np.arange(5), 9)))
    found = B.bootstrap_roc_draws(panel, 30, 5, 9, parts=parts)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    draws = {r["replicate"]: r["roc_auc"] for r in found.collect()}
    y, s = arrays(rows)
    assert len(draws) == 5
    for b, value in draws.items():
        repeat = np.array([weights[r[0]][b] for r in rows])
        assert value == pytest.approx(auc(np.repeat(y, repeat), np.repeat(s, repeat)))


def test_hashed_weights_are_poisson_counts_of_object_and_replicate():
    ids = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 4000)
    w = B.poisson_weights(ids, np.arange(60), 3)
    for k in range(4):
        assert (w == k).mean() == pytest.approx(np.exp(-1) / [1, 1, 2, 6][k], abs=0.004)
    assert w.mean(axis=0).std() < 0.03 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
    assert (w[:, 7:9] == B.poisson_weights(ids, np.arange(7, 9), 3)).all() and (w != B.poisson_weights(ids, np.arange(60), 4)).any()


def test_hashed_interval_is_near_the_exact_one(panel):
    def interval(multinomial):
        return B._interval(B.bootstrap_roc_draws(panel, 30, 400, 1, multinomial=multinomial), "roc_auc", "low", "high").first()
    own, exact = interval(False), interval(True)
    width = exact["high"] - exact["low"]
    assert abs(own["low"] - exact["low"]) < 0.25 * width and abs(own["high"] - exact["high"]) < 0.25 * width


def test_weights_over_many_slices(monkeypatch, panel):
    monkeypatch.setattr(B, "SLICE_OBJECTS", 7)
    monkeypatch.setattr(B, "CHUNK", 20)
    weights = list(weights_of(panel, 50, 4).values())
    assert len(weights) == 40 and {len(w) for w in weights} == {50}
    assert (np.sum(weights, axis=0) == 40).all()
    assert len(weights) == 40 and (np.sum(weights, axis=0) == 40).all()
    assert np.mean([w == 0 for ws in weights for w in ws]) == pytest.approx((1 - 1 / 40) ** 40, abs=0.03)


def test_roc_interval_covers_the_estimate(panel):
    got = B.bootstrap_roc(panel, 30, 100).first()
    assert got["roc_lo"] < M.discrimination(panel).first()["roc_auc"] < got["roc_hi"]


@pytest.mark.parametrize("parts", [2, 200, None])
def test_concordance_against_all_pairs(spark, parts, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_ROWS", 20)  # without a given number of parts their number follows the rows
    rng = np.random.default_rng(1)
    objects = [(int(d), int(e), float(s)) for d, e, s in zip(rng.integers(1, 40, 300), rng.random(300) < 0.4, rng.normal(size=300).round(1))]
    objects += [(5, 1, 0.0), (5, 0, 0.0)] * 60  # a hot score
    right = pairs = 0
    for d, e, s in objects:
        for d2, e2, s2 in objects:
            if e and (d < d2 or (d == d2 and not e2)):
                pairs += 1
                right += 1 if s > s2 else 0.5 if s == s2 else 0
    df = spark.createDataFrame([(float(d), e, s) for d, e, s in objects], "duration double, event int, score double")
    assert C.c_index(df, parts=parts).first()["c_index"] == pytest.approx(right / pairs)


def test_hazard_and_residual(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 0), ("c", 2.0, 1), ("d", 3.0, 1)], "object_id string, duration double, event int")
    hazard = {r["duration"]: r["hazard"] for r in C.cumulative_hazard(df).collect()}
    assert hazard == {1.0: 0.25, 2.0: pytest.approx(0.25 + 1 / 3), 3.0: pytest.approx(0.25 + 1 / 3 + 1)}
    residual = {r["object_id"]: r["residual"] for r in C.event_residual(df).collect()}
    assert residual["b"] == pytest.approx(-(0.25 + 1 / 3)) and sum(residual.values()) == pytest.approx(0)


@pytest.mark.parametrize("good, bad, sample", [(30, 70, 20), (30, 70, 90), (3 * 10**9, 7 * 10**9, 10**4), (5, 4 * 10**9, 2 * 10**9),
                                               (0, 10, 4), (10, 0, 4), (4, 4, 0), (4, 4, 8)])
def test_draws_without_replacement_at_every_size(good, bad, sample):
    drawn = np.array([B._hypergeometric(np.random.default_rng([7, i]), good, bad, sample) for i in range(1500)])
    total = good + bad
    mean = sample * good / total
    spread = (mean * (bad / total) * ((total - sample) / max(total - 1, 1))) ** 0.5
    assert drawn.min() >= max(0, sample - bad) and drawn.max() <= min(good, sample)
    assert abs(drawn.mean() - mean) <= 4 * spread / 1500 ** 0.5 and abs(drawn.std() - spread) <= 0.1 * spread
