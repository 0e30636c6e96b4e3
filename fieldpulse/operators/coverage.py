"""Exact distinct counts that can be added up: bitmaps of object numbers by day.

Every object gets a number once. A day's objects are bits in buckets of 32768 numbers; partial bitmaps of a bucket, from any
number of batches and in any order, are joined by OR. Days, months or any other set of days are counted from the same table
without a look at the readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse.functions.values import epoch_date
from fieldpulse.session import cut_lineage
from fieldpulse.sources.tables import append_rows, read_or_empty

NUMBERS = T.StructType([T.StructField("object_id", T.StringType()), T.StructField("number", T.LongType())])
BITMAPS = T.StructType([T.StructField("date", T.DateType()), T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType())])
STRIDE = 1 << 33  # numbers that one task of one batch may give away


def number_objects(objects: DataFrame, path: str) -> DataFrame:
    """Numbers of all objects seen so far; new ones of ``objects`` are numbered and appended. One writer at a time.

    A number is the place of a row within its task above the task's own range, so no task sees all new objects.
    """
    spark = objects.sparkSession
    known = read_or_empty(spark, path, NUMBERS)
    fresh = objects.select("object_id").where("object_id IS NOT NULL").distinct().join(known, "object_id", "left_anti")
    top = known.agg(F.max("number").alias("n")).first()["n"]
    base = 0 if top is None else (top // STRIDE + 1) * STRIDE
    append_rows(cut_lineage(fresh.select("object_id", (F.monotonically_increasing_id() + base).alias("number"))), path)
    return read_or_empty(spark, path, NUMBERS)


def day_bitmaps(readings: DataFrame, numbers: DataFrame) -> DataFrame:
    """date, bucket and bits of the objects with readings; a partial table of a batch, or the whole one of a store."""
    days = readings.select("object_id", epoch_date("ts_recorded").alias("date")).distinct().join(numbers, "object_id")
    return days.groupBy("date", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def merged_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """One row per day and bucket."""
    return bitmaps.groupBy("date", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_objects(bitmaps: DataFrame, *by: Column) -> DataFrame:
    """Exact ``objects_count`` of each group of days, for instance by day, by month, or of all days without ``by``."""
    groups = [F.col("date").alias("date")] if not by else list(by)
    merged = bitmaps.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    names = [c for c in merged.columns if c not in ("bucket", "bits")]
    return merged.groupBy(*names).agg(F.sum(F.bitmap_count("bits")).alias("objects_count"))
