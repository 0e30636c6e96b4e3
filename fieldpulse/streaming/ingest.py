"""Continuous counterparts of ingest, day roll-up, orders and coverage.

The ingest has no watermark: history may arrive in any order, and every micro-batch is freed of repeats and compared with
the store, so one copy of each record is kept whatever its delay. The roll-ups close days and sessions by a watermark and
leave out rows that come later than it; what is still open is added from the store by ``with_open_days`` and
``with_open_orders``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldpulse.operators.cleaning import clean_ingest, dedup_records
from fieldpulse.operators.coverage import BITMAPS, day_bitmaps, number_objects
from fieldpulse.schemas import SENSORS
from fieldpulse.session import cut_lineage
from fieldpulse.sources.key_index import KeyIndex, merge_sensors
from fieldpulse.sources.tables import append_rows, read_or_empty


MIN_SECOND = -(1 << 62)  # before every reading


def with_event_time(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Event time from the recording seconds, watermarked."""
    return stream.withColumn("event_time", F.timestamp_seconds("ts_recorded")).withWatermark("event_time", delay)


def stream_ingest(stream: DataFrame, store: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Clean a stream of normalised readings and append unseen records to the partitioned store.

    Each micro-batch keeps one row per record id and is compared with the ids of its buckets, so a replayed batch appends
    nothing twice and a reading is kept however late it comes.
    """
    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        merge_sensors(KeyIndex(spark, f"{store}_ids", "record_id"), store, cut_lineage(dedup_records(batch.select(*SENSORS.names))))

    return (clean_ingest(stream).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_daily(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Object-day means and counts, emitted once a day is closed."""
    day = F.window("event_time", "1 day")
    return with_event_time(stream, delay).groupBy("object_id", day).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ("t_supply", "t_return", "p_supply", "p_return")],
        F.min("p_supply").alias("p_supply_min"), F.max("p_supply").alias("p_supply_max"),
        F.count(F.lit(1)).alias("n_samples"),
    ).withColumn("date", F.col("window.start").cast("date")).drop("window")


def stream_orders(alerts: DataFrame, cooldown_days: int, delay: str = "1 day") -> DataFrame:
    """Orders from alert rows (object_id, event_time, score), emitted once an order has cooled down.

    A session closes when the next alert comes later than the cooldown; an alert exactly the cooldown later still
    belongs to it.
    """
    session = F.session_window("event_time", f"{cooldown_days} days")
    return alerts.withWatermark("event_time", delay).groupBy("object_id", session).agg(
        F.min("event_time").cast("date").alias("opened_at"), F.max("event_time").cast("date").alias("last_alert_at"),
        F.count(F.lit(1)).alias("alerts"), F.max("score").alias("peak_score")).drop("session_window")


def stream_coverage(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Objects per day, approximately counted, emitted once a day is closed."""
    return with_event_time(stream, delay).groupBy(F.window("event_time", "1 day")).agg(
        F.approx_count_distinct("object_id", 0.01).alias("objects_count")).select(
        F.col("window.start").cast("date").alias("date"), "objects_count")


def stream_bitmaps(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the exact coverage of a stream: every micro-batch adds the bits of its days. Bits that come twice change nothing,
    so neither late readings nor a repeated batch do harm."""
    def add(batch: DataFrame, _: int) -> None:
        rows = cut_lineage(batch.select("object_id", "ts_recorded"))
        append_rows(day_bitmaps(rows, number_objects(rows, f"{folder}/numbers")), f"{folder}/bitmaps")

    return (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stored_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    return read_or_empty(spark, f"{folder}/bitmaps", BITMAPS)


def with_open_days(closed: DataFrame, stored: DataFrame, roll_up: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Closed days of a roll-up and the days after the last of them, computed by the same function from stored readings.

    The days are a range on the stored seconds, so only the newest part of the store is read.
    """
    last = closed.agg(F.max("date").alias("d")).select((F.unix_date("d") + 1).cast("bigint") * 86400).scalar()
    return closed.unionByName(roll_up(stored.where(F.col("ts_recorded") >= F.coalesce(last, F.lit(MIN_SECOND)))))


def with_open_orders(closed: DataFrame, alerts: DataFrame, cooldown_days: int) -> DataFrame:
    """Closed orders and those still open: the alerts of each object after its last closed order, cooldown of a day or more."""
    last = closed.groupBy("object_id").agg(F.max("last_alert_at").alias("_last"))
    rest = alerts.join(last, "object_id", "left").where(
        F.col("_last").isNull() | (F.col("event_time").cast("date") > F.col("_last"))).drop("_last")
    return closed.unionByName(stream_orders(rest, cooldown_days))


def write_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's closed rows to a Parquet table, taking what is available now."""
    return (df.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def drain(start: Callable[[], StreamingQuery], rounds: int = 2) -> None:
    """Run an available-now query to its end; a further round lets the last watermark close what it can."""
    for _ in range(rounds):
        start().awaitTermination()
