"""Object-level risk: a survival forest on the time to an object's first failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.models.survival_trees import SurvivalForest, train_forest
from fieldpulse.operators.survival import c_index

SEED = 42


def train_chronic(objects: DataFrame, features: list[str], trees: int = 200, leaf: int = 20) -> SurvivalForest:
    """Survival trees with log-rank splits; missing values become the median."""
    return train_forest(objects, features, trees, leaf, SEED)


def predict_chronic(model: SurvivalForest, objects: DataFrame) -> DataFrame:
    """Adds ``chronic_score``: higher means a failure is expected earlier."""
    return model.transform(objects)


def holdout_c_index(objects: DataFrame, features: list[str], share: float = 0.25, seed: int = SEED,
                    trees: int = 200, leaf: int = 20) -> float | None:
    """Concordance on objects kept out of a separate fit; None with fewer than two failures on either side."""
    held = F.pmod(F.xxhash64(F.col("object_id").cast("string"), F.lit(seed)), F.lit(10000)) < int(share * 10000)
    marked = objects.withColumn("_held", held)
    counts = {r["_held"]: r["n"] for r in marked.groupBy("_held").agg(F.sum("event").alias("n")).collect()}
    if (counts.get(True) or 0) < 2 or (counts.get(False) or 0) < 2:
        return None
    model = train_chronic(marked.where("NOT _held").drop("_held"), features, trees, leaf)
    scored = predict_chronic(model, marked.where("_held").drop("_held"))
    return c_index(scored, "chronic_score").first()["c_index"]
