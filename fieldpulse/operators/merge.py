"""Keyed merges: insert only, partial update, last write wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.values import epoch_date
from fieldpulse.operators.cleaning import pick_row


def insert_new(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of a de-duplicated batch whose key is not stored yet.

    Only the key column of the store is read, and it is first reduced to the keys the batch brings: the store is
    filtered where it lies when the batch is small, and what meets the batch is never larger than the batch.
    """
    known = existing.select(key).join(batch.select(key), key, "left_semi")
    return batch.join(known, key, "left_anti")


def merge_stats(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """(inserted, skipped_duplicates) of a merge."""
    new = inserted.agg(F.count(F.lit(1)).alias("n"))
    return batch.agg(F.count(F.lit(1)).alias("total")).withColumn("inserted", new.scalar()).select(
        "inserted", (F.col("total") - F.col("inserted")).alias("skipped_duplicates"))


def merged(existing: DataFrame, inserted: DataFrame) -> DataFrame:
    """The store after an append."""
    return existing.unionByName(inserted)


def apply_updates(objects: DataFrame, updates: DataFrame, key: str = "object_id") -> DataFrame:
    """Overwrite only the non-null fields an update brings; unknown ids change nothing. One update row per key."""
    fields = [c for c in updates.columns if c != key and c in objects.columns]
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = objects.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in objects.columns])


def upsert_latest(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins: batch rows beat stored rows, later batch rows (by ``order``) beat earlier ones."""
    old = existing.withColumns({"_src": F.lit(0), order: F.lit(None).cast(batch.schema[order].dataType)})
    both = old.unionByName(batch.withColumn("_src", F.lit(1)))
    return pick_row(both, [key], ["_src", order], last=True).select(*existing.columns)


def upsert_stats(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """(added, updated) distinct keys of an upsert."""
    keys = batch.select(key).distinct().join(existing.select(key, F.lit(1).alias("_old")).distinct(), key, "left")
    return keys.agg(F.count_if(F.col("_old").isNull()).alias("added"), F.count("_old").alias("updated"))


def missing_days(stored: DataFrame, first: str, last: str, date: str = "date") -> DataFrame:
    """Calendar days of [first, last] that the table lacks."""
    spark = stored.sparkSession
    span = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(date))
    return span.join(stored.select(date), date, "left_anti")


def ingest_stats(batch: DataFrame, inserted: DataFrame, new_objects: DataFrame) -> DataFrame:
    """Totals of an upload: rows added and skipped, objects added, recorded period, distinct objects."""
    rows = inserted.agg(F.count(F.lit(1)).alias("n"))
    objects = new_objects.agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("ts_recorded") > 0, F.col("ts_recorded"))
    return batch.agg(
        F.count(F.lit(1)).alias("total"), F.min(known).alias("period_from"), F.max(known).alias("period_to"),
        F.count_distinct("object_id").alias("objects_count"),
    ).withColumn("sensors_inserted", rows.scalar()).select(
        "sensors_inserted", (F.col("total") - F.col("sensors_inserted")).alias("sensors_duplicates"),
        objects.scalar().alias("objects_upserted"),
        "period_from", "period_to", "objects_count")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def recorded_days(df: DataFrame) -> DataFrame:
    """Distinct (object, day) pairs with readings."""
    return df.select("object_id", epoch_date("ts_recorded").alias("date")).distinct()
