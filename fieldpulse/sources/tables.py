"""Stored tables: reading, partitioned appends, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from fieldpulse.functions.values import epoch_date, finite_frame

MONTH = "event_month"


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table with a known schema; a table never written yet is empty, not an error."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    have = set(stored.columns)
    cols = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    extra = [c for c in (MONTH,) if c in have and c not in schema.names]
    return finite_frame(stored.select(*cols, *extra))


def read_batches(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """All staged files of one upload as a single table."""
    return finite_frame(spark.read.schema(schema).parquet(*paths))


def with_month(df: DataFrame, moment: str = "ts_recorded") -> DataFrame:
    """Month of a unix-seconds column: the partition a row is stored in."""
    return df.withColumn(MONTH, F.date_format(epoch_date(moment), "yyyy-MM"))


def rebalanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows regrouped by columns into evenly sized tasks: small groups share one, a huge group is split."""
    return df.hint("rebalance", *[F.col(c) for c in columns])


CHANGES = T.StructType([T.StructField("change", T.StringType()), T.StructField(MONTH, T.StringType()),
                        T.StructField("first_measured", T.LongType()), T.StructField("last_measured", T.LongType())])


def note_changes(df: DataFrame, path: str) -> None:
    """Note which months an append brings, and from when to when their readings were measured: a row per month."""
    change = df.groupBy(MONTH).agg(F.min("ts_measurement").alias("first_measured"), F.max("ts_measurement").alias("last_measured"))
    append_rows(change.select(F.lit(uuid.uuid4().hex).alias("change"), "*").coalesce(1), f"{path}_changes")


def append_sensors(df: DataFrame, path: str) -> int:
    """Append readings to month partitions, sorted for object range scans; returns the rows written.

    Nothing already stored is rewritten. Rows are routed by month and object group, and adaptive execution sizes the
    writing tasks by bytes, so neither a decade of history nor one busy object or month ends up in a single task. The
    months are noted first: a note without its rows costs a rebuild of those months, rows without a note would be missed.
    """
    note_changes(with_month(df), path)
    rows = Observation("append_sensors")
    routed = with_month(df).withColumn("_group", F.pmod(F.xxhash64("object_id"), F.lit(1024)))
    # observed in the writing stage itself, where a repeated task counts once
    (rebalanced(routed, MONTH, "_group").drop("_group")
     .sortWithinPartitions(MONTH, "object_id", "ts_recorded")
     .observe(rows, F.count(F.lit(1)).alias("rows"))
     .write.mode("append").partitionBy(MONTH).parquet(path))
    return rows.get["rows"]


def append_rows(df: DataFrame, path: str) -> int:
    """Append to a small table."""
    rows = Observation("append_rows")
    df.observe(rows, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(path)
    return rows.get["rows"]


VERSIONS = T.StructType([T.StructField("version", T.LongType()), T.StructField("suffix", T.StringType())])


def current_path(spark: SparkSession, path: str) -> str:
    """Where the newest whole version of a replaceable table lies: ``path`` itself until its first replacement."""
    newest = read_or_empty(spark, f"{path}_versions", VERSIONS).agg(F.max_by("suffix", "version").alias("suffix")).first()
    return f"{path}-{newest['suffix']}" if newest["suffix"] else path


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version of a table beside the old one, then make it the current one by a single appended row.

    A job that fails on the way leaves the old version in force, and ``df`` may read it. One writer at a time; old
    versions stay until someone removes them.
    """
    spark, suffix = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}-{suffix}")
    last = read_or_empty(spark, f"{path}_versions", VERSIONS).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()
    append_rows(spark.createDataFrame([(last["v"] + 1, suffix)], VERSIONS).coalesce(1), f"{path}_versions")


def between_days(df: DataFrame, first: str | None = None, last: str | None = None,
                 moment: str = "ts_recorded") -> DataFrame:
    """Rows whose day lies in [first, last], as a range on the stored seconds plus a prune on the month partition."""
    if first is not None:
        df = df.where(F.col(moment) >= F.unix_date(F.lit(first).cast("date")).cast("bigint") * 86400)
    if last is not None:
        df = df.where(F.col(moment) < (F.unix_date(F.lit(last).cast("date")).cast("bigint") + 1) * 86400)
    if MONTH in df.columns:
        if first is not None:
            df = df.where(F.col(MONTH) >= first[:7])
        if last is not None:
            df = df.where(F.col(MONTH) <= last[:7])
    return df


EXPORT_COLUMNS = ["object_id", "ts_measurement", "ts_recorded", "t_supply", "t_return", "p_supply", "p_return"]


def export_period(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The bulk-read projection of a period, both days included."""
    return between_days(df, first, last).select(*EXPORT_COLUMNS)


def write_export(df: DataFrame, out: str, first: str | None = None, last: str | None = None) -> int:
    """Write an export ordered by object and recording time; returns its row count."""
    rows = Observation("export")
    (export_period(df, first, last).orderBy("object_id", "ts_recorded")
     .observe(rows, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(out))
    return rows.get["rows"]


def slice_matrix(matrix: DataFrame, first: str | None = None, last: str | None = None,
                 object_ids: list[str] | None = None) -> DataFrame:
    """Rows of the stored matrix by inclusive dates and, optionally, a list of objects."""
    if first is not None:
        matrix = matrix.where(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        matrix = matrix.where(F.col("date") <= F.lit(last).cast("date"))
    if MONTH in matrix.columns:
        if first is not None:
            matrix = matrix.where(F.col(MONTH) >= first[:7])
        if last is not None:
            matrix = matrix.where(F.col(MONTH) <= last[:7])
        matrix = matrix.drop(MONTH)
    return matrix.where(F.col("object_id").isin(object_ids)) if object_ids else matrix
