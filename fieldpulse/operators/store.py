"""Calendar, coverage, catalogue and range queries over the stored tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.functions.values import DAY, epoch_date
from fieldpulse.operators.merge import recorded_days
from fieldpulse.schemas import OBJECTS
from fieldpulse.sources.tables import MONTH, between_days


def page(df: DataFrame, keys: list[str], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one-row total) under the same predicate. ``keys`` must order the rows completely."""
    return df.orderBy(*keys).offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


def page_after(df: DataFrame, keys: list[str], last: tuple, limit: int) -> DataFrame:
    """The next rows after the last one seen, given by its values of ``keys``, which order the rows and are never NULL.

    However deep the page, every task passes on at most ``limit`` rows, and the bound on the first key reaches the scan.
    """
    later, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, last, strict=True):
        later = later | (same & (F.col(key) > F.lit(value)))
        same = same & (F.col(key) == F.lit(value))
    return df.where(F.col(keys[0]) >= F.lit(last[0])).where(later).orderBy(*keys).limit(limit)


def seconds_between(df: DataFrame, moment: str, from_ts: int | None = None, to_ts: int | None = None,
                    object_id: str | None = None) -> DataFrame:
    """Inclusive range on a unix-seconds column, optionally for one object; every predicate reaches the scan."""
    if object_id is not None:
        df = df.where(F.col("object_id") == object_id)
    if from_ts is not None:
        df = df.where(F.col(moment) >= from_ts)
    return df.where(F.col(moment) <= to_ts) if to_ts is not None else df


def _month(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m")


def sensors_between(df: DataFrame, object_id: str | None = None, from_ts: int | None = None,
                    to_ts: int | None = None) -> DataFrame:
    """Readings by recording time; a table stored by month is pruned to the months of the range."""
    if MONTH in df.columns:
        if from_ts is not None:
            df = df.where(F.col(MONTH) >= _month(from_ts))
        if to_ts is not None:
            df = df.where(F.col(MONTH) <= _month(to_ts))
    return seconds_between(df, "ts_recorded", from_ts, to_ts, object_id)


def incidents_between(df: DataFrame, object_id: str | None = None, from_ts: int | None = None,
                      to_ts: int | None = None) -> DataFrame:
    """Incidents by opening time."""
    return seconds_between(df, "incident_ts", from_ts, to_ts, object_id)


def object_calendar(df: DataFrame, object_id: str | None = None) -> DataFrame:
    """Days with readings, of one object or of all."""
    return recorded_days(df if object_id is None else df.where(F.col("object_id") == object_id))


def neighbour_days(df: DataFrame) -> DataFrame:
    """Each object's days with the previous and the next day that has data. One row per object and day."""
    w = Window.partitionBy("object_id").orderBy("date")
    return recorded_days(df).withColumns({"prev_day": F.lag("date").over(w), "next_day": F.lead("date").over(w)})


def coverage_summary(df: DataFrame, first: str | None = None, last: str | None = None,
                     approximate: bool = False) -> DataFrame:
    """Objects with readings per day."""
    days = between_days(df, first, last).select("object_id", epoch_date("ts_recorded").alias("date"))
    count = F.approx_count_distinct("object_id") if approximate else F.count_distinct("object_id")
    return days.groupBy("date").agg(count.alias("objects_count"))


def store_health(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("sensors_count"), F.min("ts_recorded").alias("_a"),
                  F.max("ts_recorded").alias("_b")).select(
        "sensors_count", epoch_date("_a").alias("period_from"), epoch_date("_b").alias("period_to"))


def incident_health(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("incidents_count"),
                  F.count_distinct("object_id").alias("incidents_objects"))


def table_health(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows, objects and period of a table with one row per object and day."""
    objects = F.count_distinct("object_id") if "object_id" in df.columns else F.lit(None).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("rows"), objects.alias("objects"),
                  F.min(date).alias("date_from"), F.max(date).alias("date_to"))


def incident_objects(df: DataFrame) -> DataFrame:
    return df.select("object_id").distinct()


def objects_on_day(sensors: DataFrame, meta: DataFrame, date: str) -> DataFrame:
    """Objects with readings on a day and what is known about them; unknown objects keep their id."""
    active = between_days(sensors, date, date).select("object_id").distinct()
    return active.join(meta.select(*OBJECTS.names), "object_id", "left")


def search_objects(meta: DataFrame, municipality: str | None = None, facility_type: str | None = None,
                   text: str | None = None) -> DataFrame:
    """Catalogue by district, type and a case-insensitive piece of the name (with the usual % and _ wildcards)."""
    if municipality:
        meta = meta.where(F.col("municipality") == municipality)
    if facility_type:
        meta = meta.where(F.col("facility_type") == facility_type)
    return meta.where(F.col("facility_name").ilike(f"%{text}%")) if text else meta


def object_by_id(meta: DataFrame, object_id: str) -> DataFrame:
    return meta.where(F.col("object_id") == object_id).limit(1)


def weather_between(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    if first is not None:
        df = df.where(F.col("date") >= F.lit(first).cast("date"))
    return df.where(F.col("date") <= F.lit(last).cast("date")) if last is not None else df


def day_profiles(sensors: DataFrame, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """Raw readings of the wanted (object, date) pairs, from midnight to the next midnight, both included.

    A midnight reading belongs to two days, so each reading offers itself to its own day and, at midnight, to the day
    before; the match is then an equality. All readings are returned unless the caller asks for the first ``limit`` of each
    object and day.
    """
    own = epoch_date("ts_recorded")
    midnight = F.col("ts_recorded") % DAY == 0
    days = F.when(midnight, F.array(own, F.date_sub(own, 1))).otherwise(F.array(own))
    rows = sensors.select("*", F.explode(days).alias("date")).join(
        wanted.select("object_id", "date").distinct(), ["object_id", "date"], "left_semi")
    if limit is not None:
        order = Window.partitionBy("object_id", "date").orderBy("ts_recorded", "record_id")
        rows = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit)
    return rows.select("object_id", "date", "ts_recorded", "t_supply", "t_return", "p_supply", "p_return")
