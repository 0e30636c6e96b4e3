"""Training run: panel, three models, alert rules, honest report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.models import acute, chronic, lifetime
from fieldpulse.models.boosting import BoostedTrees
from fieldpulse.models.contract import Manifest
from fieldpulse.models.lifetime import LogNormalLifetime
from fieldpulse.models.survival_trees import SurvivalForest
from fieldpulse.operators import metrics, resampling, rules, target
from fieldpulse.operators.risk import chronic_top_by_score
from fieldpulse.schemas import (
    ALERT_RATE, BASELINE_DAYS, CHRONIC_FRACTIONS, COOLDOWN_DAYS, FEATURES, HORIZON_DAYS, TARGET_DETECTION,
)
from fieldpulse.session import cut_lineage


@dataclass(frozen=True)
class TrainSettings:
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    val_start: str | None = None
    test_start: str | None = None
    alert_rate: float = ALERT_RATE
    baseline_days: int = BASELINE_DAYS
    cooldown_days: int = COOLDOWN_DAYS
    rounds: int = 1000
    patience: int = 50
    trees: int = 200
    leaf: int = 20
    replicates: int | None = None  # None: 400 permutations, 500 bootstrap draws
    seed: int = 0


@dataclass(frozen=True)
class TrainResult:
    acute: BoostedTrees
    calibrator: IsotonicRegressionModel
    chronic: SurvivalForest
    lifetime: LogNormalLifetime
    manifest: Manifest
    scored_test: DataFrame
    frontier: DataFrame
    profiles: DataFrame
    windows: DataFrame
    report: DataFrame


def labelled_frame(matrix: DataFrame, incidents: DataFrame, settings: TrainSettings) -> DataFrame:
    """Matrix with target and split, written once; every split must hold rows."""
    if matrix.isEmpty():
        raise ValueError("the feature matrix is empty")
    if incidents.isEmpty():
        raise ValueError("there are no incidents to learn from")
    frame = cut_lineage(target.temporal_split(
        target.add_target(matrix, incidents), settings.val_start, settings.test_start))
    present = {r["split"] for r in frame.select("split").distinct().collect()}
    for name in target.SPLITS:
        if name not in present:
            raise ValueError(f"split {name} is empty, check the period bounds")
    return frame


def train_run(matrix: DataFrame, incidents: DataFrame, settings: TrainSettings = TrainSettings()) -> TrainResult:
    """Everything between the feature matrix and a publishable set of models."""
    cols = settings.features
    frame = labelled_frame(matrix, incidents, settings)
    train, val, test = (frame.where(F.col("split") == s) for s in target.SPLITS)

    model = acute.train_acute(train, val, cols, settings.rounds, patience=settings.patience)
    scored_val = cut_lineage(acute.predict_acute(model, val).select("object_id", "date", "y", "score"))
    calibrator = acute.fit_calibrator(scored_val)
    threshold = metrics.budget_threshold(scored_val, settings.alert_rate).first()["threshold"]
    scored_test = cut_lineage(acute.predict_acute(model, test).select("object_id", "date", "t_to_failure", "y", "score"))

    # object-level models learn only from what happened before the test window
    objects = cut_lineage(target.object_level(frame.where("split <> 'test'"), cols, settings.baseline_days))
    forest = chronic.train_chronic(objects, cols, settings.trees, settings.leaf)
    ranked = cut_lineage(chronic.predict_chronic(forest, objects).select("object_id", "chronic_score"))
    gates = {name: chronic_top_by_score(ranked, share) for name, share in CHRONIC_FRACTIONS.items()}
    held_out = chronic.holdout_c_index(objects, cols, trees=settings.trees, leaf=settings.leaf)
    aft = lifetime.train_lifetime(objects, cols)

    profiles = rules.default_profiles(list(gates))
    base = cut_lineage(rules.sweep_input(scored_test, profiles, gates))
    frontier = cut_lineage(rules.sweep(base, profiles, cooldown_days=settings.cooldown_days))
    return TrainResult(
        acute=model, calibrator=calibrator, chronic=forest, lifetime=aft,
        manifest=Manifest(threshold=threshold, alert_rate=settings.alert_rate, columns=tuple(cols),
                          baseline_days=settings.baseline_days),
        scored_test=scored_test, frontier=frontier, profiles=rules.pick_profiles(frontier, TARGET_DETECTION),
        windows=target.split_windows(frame),
        report=evaluation_report(scored_test, threshold, settings, held_out))


def evaluation_report(scored: DataFrame, threshold: float, settings: TrainSettings,
                      c_index: float | None = None) -> DataFrame:
    """One row: discrimination, detection with its floor and lift, permutation and bootstrap intervals."""
    seed, draws = settings.seed, settings.replicates
    parts = [
        metrics.discrimination(scored, HORIZON_DAYS),
        metrics.detection(scored, threshold, HORIZON_DAYS),
        resampling.permutation_null(scored, threshold, draws or 400, seed).select(
            F.col("p_value").alias("lift_p_value"), F.col("null_mean").alias("null_permutation")),
        resampling.bootstrap_detection(scored, threshold, draws or 500, seed),
        resampling.bootstrap_roc(scored, HORIZON_DAYS, draws or 500, seed),
    ]
    # every part is one row; they meet on a constant
    report = scored.sparkSession.range(1).select(
        F.lit(1).alias("_one"), F.lit("temporal").alias("split"), F.lit(threshold).alias("threshold"),
        F.lit(c_index).cast("double").alias("chronic_c_index"))
    for part in parts:
        report = report.join(part.withColumn("_one", F.lit(1)), "_one", "left")
    return report.withColumn("n_events", F.col("fail_objects")).drop("_one")
