"""Median time to failure from a log-normal survival regression with a ridge term.

log(days) = intercept + x * coefficients + sigma * noise, where objects without a failure only say that they lasted longer. The
mean log-likelihood, less half the ridge times the squared coefficients of columns scaled to unit spread, is maximised by
Newton steps; gradient and Hessian of all parameters are summed over the objects in one pass, censored objects by the tail of
the normal distribution.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.models.prep import medians, varying
from fieldpulse.session import cut_lineage

RIDGE = 0.1
STEPS = 50
FAR = 25.0  # beyond it the tail of the normal distribution is taken from its expansion

_erfc = np.vectorize(math.erfc, otypes=[float])


def log_tail(z: np.ndarray) -> np.ndarray:
    """log P(N > z)."""
    near = np.minimum(z, FAR)
    far = np.maximum(z, FAR)
    expansion = -far * far / 2 - np.log(far * math.sqrt(2 * math.pi)) + np.log1p(-1 / far**2 + 3 / far**4 - 15 / far**6)
    return np.where(z > FAR, expansion, np.log(0.5 * _erfc(near / math.sqrt(2))))


def derivatives(x: np.ndarray, y: np.ndarray, event: np.ndarray, parameters: np.ndarray):
    """Log-likelihood (without constants), gradient and Hessian, summed over rows; the last parameter is log(sigma).

    ``x`` starts with a column of ones, ``y`` is the logarithm of the duration.
    """
    sigma = math.exp(parameters[-1])
    z = (y - x @ parameters[:-1]) / sigma
    tail = log_tail(z)
    hazard = np.exp(-z * z / 2 - 0.5 * math.log(2 * math.pi) - tail)
    bend = hazard * (hazard - z)
    value = np.where(event, -parameters[-1] - z * z / 2 - 0.5 * math.log(2 * math.pi), tail).sum()
    to_mean = np.where(event, z, hazard) / sigma
    to_spread = np.where(event, z * z - 1, z * hazard)
    mean2 = np.where(event, -1.0, -bend) / sigma**2
    mixed = np.where(event, -2 * z, -(hazard + z * bend)) / sigma
    spread2 = np.where(event, -2 * z * z, -z * (hazard + z * bend))
    gradient = np.r_[x.T @ to_mean, to_spread.sum()]
    hessian = np.empty((len(parameters), len(parameters)))
    hessian[:-1, :-1] = (x * mean2[:, None]).T @ x
    hessian[:-1, -1] = hessian[-1, :-1] = x.T @ mixed
    hessian[-1, -1] = spread2.sum()
    return value, gradient, hessian


def _summed(names: list[str], parameters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + len(parameters) + len(parameters)**2)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (*names, "_log", "_event")}
            x = np.column_stack([np.ones(batch.num_rows), *[column[c] for c in names]])
            value, gradient, hessian = derivatives(x, column["_log"], column["_event"] > 0, parameters)
            total += np.r_[value, gradient, hessian.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])
    return run


def newton(objective, parameters: np.ndarray, penalty: np.ndarray, rows: float, steps: int = STEPS) -> np.ndarray:
    """Maximise ``objective`` (value, gradient and Hessian at given parameters) / rows - penalty * parameters^2 / 2.

    A step that does not gain is halved; a Hessian that is not negative definite gets a larger diagonal.
    """
    def at(p):
        value, gradient, hessian = objective(p)
        return value / rows - (penalty * p * p).sum() / 2, gradient / rows - penalty * p, hessian / rows - np.diag(penalty)

    value, gradient, hessian = at(parameters)
    for _ in range(steps):
        shift = 0.0
        while True:
            try:
                np.linalg.cholesky(-hessian + shift * np.eye(len(parameters)))
                break
            except np.linalg.LinAlgError:
                shift = max(2 * shift, 1e-6)
        step = np.linalg.solve(-hessian + shift * np.eye(len(parameters)), gradient)
        share = 1.0
        while share > 1e-6:
            found = at(parameters + share * step)
            if found[0] >= value:
                break
            share /= 2
        else:
            break
        gained, parameters = found[0] - value, parameters + share * step
        value, gradient, hessian = found
        if np.abs(gradient).max() < 1e-9 or gained < 1e-14 * max(1.0, abs(value)) and np.abs(gradient).max() < 1e-6:
            break
    return parameters


@dataclass
class LogNormalLifetime:
    """log(median days) = intercept + sum of coefficient * value, values filled by their median where missing."""

    columns: list[str]
    medians: list[float]
    coefficients: list[float]
    intercept: float
    sigma: float

    def transform(self, objects: DataFrame, out: str = "aft_median_days") -> DataFrame:
        """Adds ``out``: plain SQL, nothing leaves the JVM."""
        line = F.lit(self.intercept)
        for c, filling, k in zip(self.columns, self.medians, self.coefficients):
            line = line + F.lit(k) * F.coalesce(F.col(c).cast("double"), F.lit(filling))
        return objects.withColumn(out, F.exp(line))

    def save(self, path: str) -> None:
        SparkSession.getActiveSession().createDataFrame([(json.dumps(asdict(self)),)], "model string").write.parquet(path)

    @staticmethod
    def load(path: str) -> LogNormalLifetime:
        return LogNormalLifetime(**json.loads(SparkSession.getActiveSession().read.parquet(path).first()["model"]))


def train_lifetime(objects: DataFrame, features: list[str], ridge: float = RIDGE) -> LogNormalLifetime:
    """Fit on all given features that vary, censored where no failure was seen; durations must be above zero.

    Columns are scaled by their spread while fitting, so the ridge treats them alike; intercept and sigma are not penalised.
    """
    filling = medians(objects, [c for c in features if c in objects.columns])
    filled = objects.select("duration", "event", *[F.coalesce(F.col(c).cast("double"), F.lit(filling[c])).alias(c) for c in filling])
    columns = varying(filled, list(filling))
    spread = filled.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first() if columns else {}
    names = [f"_{i}" for i in range(len(columns))]
    rows = cut_lineage(filled.where("duration > 0").select(
        *[(F.col(c) / spread[c]).alias(n) for c, n in zip(columns, names)], F.log("duration").alias("_log"),
        F.col("event").cast("double").alias("_event")))
    start = rows.agg(F.count("*").alias("n"), F.avg("_log").alias("mean"), F.stddev_samp("_log").alias("spread"),
                     F.sum("_event").alias("events")).first()
    if not start["n"] or not start["events"]:
        raise ValueError("a time to failure needs objects that failed")
    size = len(columns) + 2

    def objective(parameters: np.ndarray):
        sums = rows.mapInArrow(_summed(names, parameters), "place int, value double").groupBy("place").agg(
            F.sum("value").alias("value")).toPandas().sort_values("place")["value"].to_numpy()
        return sums[0], sums[1:1 + size], sums[1 + size:].reshape(size, size)

    first = np.r_[start["mean"], np.zeros(len(columns)), math.log(max(start["spread"] or 1.0, 1e-3))]
    penalty = np.r_[0.0, np.full(len(columns), ridge), 0.0]
    found = newton(objective, first, penalty, start["n"])
    return LogNormalLifetime(columns, [filling[c] for c in columns],
                             [float(k / spread[c]) for k, c in zip(found[1:-1], columns)], float(found[0]), float(math.exp(found[-1])))


def predict_lifetime(model: LogNormalLifetime, objects: DataFrame) -> DataFrame:
    """Adds ``aft_median_days``."""
    return model.transform(objects)
