"""Trained sets on shared storage: training and serving may be different applications."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import SparkSession

from fieldpulse.models.boosting import BoostedTrees
from fieldpulse.models.contract import ContractError, Manifest, check_contract
from fieldpulse.models.lifetime import LogNormalLifetime
from fieldpulse.models.survival_trees import SurvivalForest
from fieldpulse.plans.train import TrainResult

MODELS = {"acute": BoostedTrees, "chronic": SurvivalForest, "lifetime": LogNormalLifetime}
TABLES = ("scored_test", "frontier", "profiles", "windows", "report")


def publish(trained: TrainResult, folder: str) -> None:
    """Write models, tables and, last of all, the manifest to a new folder.

    A folder without a manifest is an unfinished set and is never loaded; an existing folder is refused, so a set that is
    being served stays as it is.
    """
    spark = trained.report.sparkSession
    for name in MODELS:
        getattr(trained, name).save(f"{folder}/{name}")
    trained.calibrator.save(f"{folder}/calibrator")
    for name in TABLES:
        getattr(trained, name).write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(asdict(trained.manifest)),)], "manifest string").write.parquet(f"{folder}/manifest")


def read_manifest(spark: SparkSession, folder: str) -> Manifest:
    """The manifest of a finished set."""
    try:
        stored = spark.read.schema("manifest string").parquet(f"{folder}/manifest").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    if stored is None:
        raise ContractError(f"no finished set of models in {folder}")
    terms = json.loads(stored["manifest"])
    return Manifest(**terms | {"columns": tuple(terms["columns"])})


def load(spark: SparkSession, folder: str) -> TrainResult:
    """A published set, refused when it does not fit the contract served here. Its report holds the key figures."""
    manifest = read_manifest(spark, folder)
    check_contract(manifest)
    return TrainResult(
        **{name: kind.load(f"{folder}/{name}") for name, kind in MODELS.items()},
        calibrator=IsotonicRegressionModel.load(f"{folder}/calibrator"), manifest=manifest,
        **{name: spark.read.parquet(f"{folder}/{name}") for name in TABLES})
