"""Tables kept by month, every month in versions.

A rebuild writes the months that it touched as a new build beside the old ones and then switches all of them by one appended
file; the other months keep their build. A job that fails on the way changes nothing, and a table that was read before the
switch can be read to its end. One writer at a time; old builds stay until someone removes them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse.sources.tables import MONTH, append_rows, read_or_empty, rebalanced

BUILD = "build"
_LOG = T.StructType([T.StructField(MONTH, T.StringType()), T.StructField(BUILD, T.StringType()), T.StructField("seq", T.LongType())])
_PARTS = [T.StructField(BUILD, T.StringType()), T.StructField(MONTH, T.StringType())]


def current_months(spark: SparkSession, path: str) -> dict[str, str]:
    """The build in force of every month: one row per month of the history."""
    log = read_or_empty(spark, f"{path}_months", _LOG)
    return {r[MONTH]: r[BUILD] for r in log.groupBy(MONTH).agg(F.max_by(BUILD, "seq").alias(BUILD)).collect()}


def read_months(spark: SparkSession, path: str, schema: T.StructType, months: list[str] | None = None) -> DataFrame:
    """The current rows with their month, of all months or of some; only their files are read. Without any, the plain schema."""
    current = {m: b for m, b in current_months(spark, path).items() if months is None or m in months}
    if not current:
        return spark.createDataFrame([], schema)
    by_build: dict[str, list[str]] = {}
    for month, build in sorted(current.items()):
        by_build.setdefault(build, []).append(month)
    stored = spark.read.schema(T.StructType([*schema.fields, *_PARTS])).option("basePath", path).parquet(
        *[f"{path}/{BUILD}={b}" for b in by_build])
    kept = reduce(lambda a, b: a | b, [(F.col(BUILD) == b) & F.col(MONTH).isin(ms) for b, ms in by_build.items()])
    return stored.where(kept).drop(BUILD)


def replace_months(df: DataFrame, path: str, months: list[str], date: str = "date") -> None:
    """Make ``df`` the content of these months; a month that it has no row of becomes empty, rows of others are left out."""
    spark, build = df.sparkSession, uuid.uuid4().hex
    if not months:
        return
    named = df.withColumn(MONTH, F.date_format(date, "yyyy-MM")).where(F.col(MONTH).isin(months))
    (rebalanced(named, MONTH).sortWithinPartitions(MONTH, "object_id", date)
     .write.partitionBy(MONTH).parquet(f"{path}/{BUILD}={build}"))
    last = read_or_empty(spark, f"{path}_months", _LOG).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"]
    append_rows(spark.createDataFrame([(m, build, last + 1) for m in months], _LOG).coalesce(1), f"{path}_months")
