"""Daily risk: boosted trees on object-days, and a calibration shown next to the raw score."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.models.boosting import BoostedTrees, train_boosted

SEED = 42


def train_acute(train: DataFrame, val: DataFrame, features: list[str], rounds: int = 1000, depth: int = 4,
                step: float = 0.05, sample: float = 0.8, patience: int = 50) -> BoostedTrees:
    """Boosted trees on train, positives weighted by the class ratio of train, stopped after ``patience`` rounds without
    gain on val. Missing values take a learned side in every split. The trees need a label both ways, which is checked first.
    """
    counts = train.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    if not counts["p"] or not counts["n"]:
        raise ValueError("training days need both failing and healthy examples")
    return train_boosted(train, val, features, weight=counts["n"] / counts["p"], rounds=rounds, patience=patience, depth=depth,
                         step=step, sample=sample, seed=SEED)


def predict_acute(model: BoostedTrees, df: DataFrame) -> DataFrame:
    """Adds the raw ``score``."""
    return model.transform(df)


def fit_calibrator(scored: DataFrame, label: str = "y") -> IsotonicRegressionModel:
    """Isotonic fit of the label on the score. Equal scores are averaged first; their weight is their count."""
    points = scored.groupBy("score").agg(F.avg(F.col(label).cast("double")).alias("label"),
                                         F.count(F.lit(1)).cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="score", labelCol="label", weightCol="weight").fit(points)


def calibrate(model: IsotonicRegressionModel, scored: DataFrame) -> DataFrame:
    """Adds ``calibrated``, clamped to the fitted range; never used for thresholds."""
    return model.setFeaturesCol("score").setPredictionCol("calibrated").transform(scored)
