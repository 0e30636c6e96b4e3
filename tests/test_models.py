import inspect
from dataclasses import replace
from datetime import date, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldpulse.models import acute, chronic
from fieldpulse.models.contract import ContractError, Manifest, check_contract
from fieldpulse.operators.metrics import roc_auc
from fieldpulse.operators.rules import Profile
from fieldpulse.plans import queries_models
from fieldpulse.plans.publish import load, publish
from fieldpulse.plans.serve import serve
from fieldpulse.plans.train import TrainSettings, train_run

COLS = ["f_trend", "f_noise", "f_season", "f_empty"]
FAST = TrainSettings(features=COLS, rounds=8, trees=10, leaf=3, replicates=40)


@pytest.fixture(scope="module")
def world(spark):
    """Sixty objects over 150 days; a third fails twice, its trend rising for twenty days before."""
    rng = np.random.default_rng(0)
    rows, incidents = [], []
    for o in range(60):
        fails = [50 + o % 40, 115 + o % 30] if o % 3 == 0 else []
        incidents += [(f"o{o}", int((date(2026, 1, 1) + timedelta(days=d) - date(1970, 1, 1)).days) * 86400) for d in fails]
        for d in range(150):
            ahead = min([f - d for f in fails if f >= d] or [999])
            ramp = max(0.0, 1 - ahead / 20) * 3
            rows.append((f"o{o}", date(2026, 1, 1) + timedelta(days=d), ramp + rng.normal() / 3 + (o % 3 == 0) / 4,
                         float(rng.normal()) if rng.random() > 0.1 else None, float(np.sin(d / 20)), None))
    matrix = spark.createDataFrame(rows, "object_id string, date date, f_trend double, f_noise double, f_season double, f_empty double").cache()
    return matrix, spark.createDataFrame(incidents, "object_id string, incident_ts bigint")


@pytest.fixture(scope="module")
def trained(world):
    return train_run(*world, FAST)


def test_planted_signal_is_found(trained):
    assert roc_auc(trained.scored_test).first()["roc_auc"] > 0.6
    report = trained.report.first().asDict()
    assert report["split"] == "temporal" and report["detection_null"] is not None
    assert report["roc_lo"] <= report["roc_auc"] <= report["roc_hi"] and report["n_events"] == report["fail_objects"] > 0
    assert 0 <= report["lift_p_value"] <= 1 and trained.windows.count() == 3


def test_profiles_have_one_default(trained):
    rows = trained.profiles.collect()
    assert {r["profile"] for r in rows} == {"baseline", "persist3", "persist5", "persist7", "ewma5", "ewma10", "gate_top30", "gate_top50"}
    assert sum(r["is_default"] for r in rows) == 1


def test_serving(trained, world):
    answers = serve(trained, world[0])
    daily = answers.daily
    assert daily.columns == ["object_id", "date", "score", "calibrated", "rank"] and daily.count() == 60 * 150
    assert daily.where("calibrated < 0 OR calibrated > 1").count() == 0
    assert answers.chronic.agg(F.min("chronic_rank")).first()[0] == 1
    cards = answers.cards()
    assert cards.count() == 60 and cards.where("aft_median_days <= 0 OR aft_median_days IS NULL").count() == 0
    everyone, gated = answers.queue(Profile("baseline")).count(), answers.queue(Profile("gate_top30", "gate", chronic_top="top30"))
    assert 0 < gated.select("object_id").distinct().count() <= 18 and everyone >= gated.count()


def test_published_set_scores_like_the_live_one(spark, trained, world, tmp_path):
    folder = str(tmp_path / "set")
    with pytest.raises(ContractError, match="no finished set"):
        load(spark, folder)
    publish(trained, folder)
    again = load(spark, folder)
    assert again.manifest == trained.manifest and again.report.count() == 1
    assert sorted(map(tuple, again.profiles.collect()), key=str) == sorted(map(tuple, trained.profiles.collect()), key=str)
    live, stored = (serve(t, world[0]) for t in (trained, again))
    for one, two in ((live.daily, stored.daily), (live.chronic, stored.chronic), (live.cards(), stored.cards())):
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    with pytest.raises(Exception, match="(?i)exist"):
        publish(trained, folder)


def test_unfit_set_is_refused(spark, trained, tmp_path):
    folder = str(tmp_path / "set")
    publish(replace(trained, manifest=replace(trained.manifest, horizon_days=60)), folder)
    with pytest.raises(ContractError, match="horizon"):
        load(spark, folder)


def test_empty_inputs_are_named(spark, world):
    matrix, incidents = world
    with pytest.raises(ValueError, match="matrix is empty"):
        train_run(matrix.limit(0), incidents, FAST)
    with pytest.raises(ValueError, match="no incidents"):
        train_run(matrix, incidents.limit(0), FAST)
    with pytest.raises(ValueError, match="split val"):
        train_run(matrix, incidents, replace(FAST, val_start="2027-01-01", test_start="2027-02-01"))


def test_calibration_is_monotone_and_clamped(spark):
    rng = np.random.default_rng(2)
    scores = rng.random(400)
    df = spark.createDataFrame([(float(s), int(rng.random() < s)) for s in scores], "score double, y int")
    model = acute.fit_calibrator(df)
    probe = spark.createDataFrame([(float(s),) for s in np.linspace(-1, 2, 50)], "score double")
    got = [r["calibrated"] for r in acute.calibrate(model, probe).orderBy("score").collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1


@pytest.mark.parametrize("change, message", [
    (dict(schema_version="2.0"), "contract version"), (dict(horizon_days=60), "horizon"),
    (dict(baseline_days=14), "baseline"), (dict(feature_version="x"), "features")])
def test_contract_is_enforced(change, message):
    good = Manifest(threshold=0.5, alert_rate=0.02)
    check_contract(good, columns=list(good.columns))
    with pytest.raises(ContractError, match=message):
        check_contract(replace(good, **change))
    with pytest.raises(ContractError, match="order"):
        check_contract(good, columns=list(good.columns)[::-1])


def test_registered_queries_train_with_the_default_settings(monkeypatch):
    full, used = TrainSettings(), {}

    def spy(name, real):
        def call(*args, **named):
            bound = inspect.signature(real).bind(*args, **named)
            bound.apply_defaults()
            used[name] = bound.arguments
            raise InterruptedError
        return call

    anything = SimpleNamespace(where=lambda *_: None, sensors=lambda: None, weather=lambda: None, incidents=lambda: None, severe_incidents=lambda: None)
    monkeypatch.setattr(queries_models, "_frame", lambda v: anything)
    monkeypatch.setattr(queries_models.X, "build_matrix", lambda *_: None)
    monkeypatch.setattr(queries_models, "train_run", spy("report", train_run))
    monkeypatch.setattr(queries_models.acute, "train_acute", spy("acute", acute.train_acute))
    object_level = queries_models.T.object_level
    monkeypatch.setattr(queries_models.T, "object_level", spy("objects", object_level))
    for build in (queries_models.train_report, queries_models.acute_scores, queries_models.chronic_model):
        with pytest.raises(InterruptedError):
            build(anything)
    monkeypatch.setattr(queries_models.T, "object_level", lambda *_: None)
    monkeypatch.setattr(queries_models, "cut_lineage", lambda df: df)
    monkeypatch.setattr(queries_models.chronic, "train_chronic", spy("chronic", chronic.train_chronic))
    with pytest.raises(InterruptedError):
        queries_models.chronic_model(anything)
    settings = used["report"]["settings"]
    assert settings == replace(full, val_start=settings.val_start, test_start=settings.test_start)
    assert used["acute"]["rounds"] == full.rounds and used["objects"]["baseline_days"] == full.baseline_days
    assert (used["chronic"]["trees"], used["chronic"]["leaf"]) == (full.trees, full.leaf)
