"""Feature vectors with medians for missing values."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Median per column that has any value: one pass, one small row."""
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10000).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def varying(df: DataFrame, columns: list[str], least: float = 1e-9) -> list[str]:
    """Columns whose spread is not practically zero."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > least]


def vector_stages(filling: dict[str, float], flags: bool, out: str = "features") -> list[Transformer]:
    """Stages that fill missing values, optionally flag them, and assemble a vector.

    Plain SQL keeps the stages storable and inside code generation.
    """
    filled = [f"coalesce(CAST(`{c}` AS DOUBLE), {value!r}D) AS `_f_{c}`" for c, value in filling.items()]
    flagged = [f"CAST(`{c}` IS NULL AS DOUBLE) AS `_m_{c}`" for c in filling] if flags else []
    names = [f"_f_{c}" for c in filling] + ([f"_m_{c}" for c in filling] if flags else [])
    return [SQLTransformer(statement=f"SELECT *, {', '.join(filled + flagged)} FROM __THIS__"),
            VectorAssembler(inputCols=names, outputCol=out)]


def without_helpers(df: DataFrame, *more: str) -> DataFrame:
    helpers = [c for c in df.columns if c.startswith(("_f_", "_m_"))]
    return df.drop(*helpers, *more)
