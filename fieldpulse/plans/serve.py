"""Scoring a feature matrix and answering the dispatcher's questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.models import acute, chronic, lifetime
from fieldpulse.models.boosting import BoostedTrees
from fieldpulse.models.contract import check_contract
from fieldpulse.operators import orders, risk
from fieldpulse.operators.rules import Profile
from fieldpulse.plans.train import TrainResult
from fieldpulse.schemas import CHRONIC_FRACTIONS, COOLDOWN_DAYS, OBJECTS
from fieldpulse.session import cut_lineage


def score_days(model: BoostedTrees, calibrator: IsotonicRegressionModel, features: DataFrame) -> DataFrame:
    """(object_id, date, score, calibrated, rank) for every object-day."""
    scored = acute.calibrate(calibrator, acute.predict_acute(model, features))
    return risk.rank_in_day(scored.select("object_id", "date", "score", "calibrated"))


@dataclass(frozen=True)
class Scored:
    """Tables computed once per set of models and read by every question."""

    daily: DataFrame
    chronic: DataFrame
    thresholds: DataFrame
    global_thresholds: DataFrame
    lifetimes: DataFrame
    meta: DataFrame
    threshold: float

    def queue(self, profile: Profile, threshold: float | None = None, date: str | None = None, gated: bool = False,
              cooldown_days: int = COOLDOWN_DAYS, n: int | None = None) -> DataFrame:
        """Orders of a profile, all or the first n, at the given threshold (0 included), else at the budget threshold."""
        members = None
        if gated or profile.kind == "gate":
            name = profile.chronic_top or "top30"
            if name not in CHRONIC_FRACTIONS:
                raise ValueError(f"unknown gate {name!r}; known are {sorted(CHRONIC_FRACTIONS)}")
            members = risk.chronic_top(self.chronic, CHRONIC_FRACTIONS[name])
        level = self.threshold if threshold is None else threshold
        queue = orders.order_queue(self.daily, profile, level, date, members, cooldown_days)
        return orders.head(orders.with_chronic_rank(queue, self.chronic), n)

    def cards(self, date: str | None = None) -> DataFrame:
        """One card per object with its expected time to failure."""
        cards = risk.object_cards(self.daily, self.thresholds, self.chronic, self.meta, date, self.threshold)
        return cards.join(self.lifetimes, "object_id", "left")


def serve(trained: TrainResult, matrix: DataFrame, meta: DataFrame | None = None) -> Scored:
    """Check the contract, score the matrix and keep what the questions need as written tables."""
    columns = list(trained.manifest.columns)
    check_contract(trained.manifest, columns=columns)
    daily = cut_lineage(score_days(trained.acute, trained.calibrator, matrix))
    baseline = cut_lineage(risk.object_baseline(matrix, columns, trained.manifest.baseline_days))
    ranked = risk.chronic_rank(chronic.predict_chronic(trained.chronic, baseline).select("object_id", "chronic_score"))
    days = lifetime.predict_lifetime(trained.lifetime, baseline).select("object_id", "aft_median_days")
    if meta is None:
        meta = matrix.sparkSession.createDataFrame([], OBJECTS)
    return Scored(daily=daily, chronic=cut_lineage(ranked), thresholds=risk.object_thresholds(daily),
                  global_thresholds=risk.global_thresholds(daily, trained.manifest.threshold),
                  lifetimes=days, meta=meta, threshold=trained.manifest.threshold)


def latest_features(matrix: DataFrame) -> DataFrame:
    """Newest row of every object."""
    newest = matrix.groupBy("object_id").agg(F.max("date").alias("date"))
    return matrix.join(newest, ["object_id", "date"])
