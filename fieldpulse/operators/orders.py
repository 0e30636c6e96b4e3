"""Inspection orders from daily scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.operators.rules import Profile, gate, mask, new_episode
from fieldpulse.schemas import COOLDOWN_DAYS


def to_orders(fired: DataFrame, cooldown_days: int = COOLDOWN_DAYS) -> DataFrame:
    """Alerts of one object within the cooldown of each other form one order."""
    w = Window.partitionBy("object_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    opened = fired.withColumn("_new", new_episode(cooldown_days).cast("int"))
    episodes = opened.withColumn("_episode", F.sum("_new").over(w))
    return episodes.groupBy("object_id", "_episode").agg(
        F.min("date").alias("opened_at"), F.max("date").alias("last_alert_at"),
        F.count(F.lit(1)).cast("int").alias("alert_days"), F.max("score").alias("peak_score")).drop("_episode")


def active_orders(orders: DataFrame, day: str, cooldown_days: int = COOLDOWN_DAYS) -> DataFrame:
    """Orders opened by a day whose last alert has not cooled down yet."""
    on = F.lit(day).cast("date")
    return orders.where((F.col("opened_at") <= on) & (F.col("last_alert_at") >= F.date_sub(on, cooldown_days)))


def order_queue(scored: DataFrame, profile: Profile, threshold: float, date: str | None = None,
                members: DataFrame | None = None, cooldown_days: int = COOLDOWN_DAYS) -> DataFrame:
    """Trigger, episodes over the whole history, optional gate, optional day. Sort by ``peak_score`` for display."""
    orders = to_orders(mask(scored, profile, threshold).where("alert"), cooldown_days)
    if members is not None:
        orders = gate(orders, members)
    return orders if date is None else active_orders(orders, date, cooldown_days)


def head(orders: DataFrame, n: int | None = None) -> DataFrame:
    """Orders by peak score, all of them or the first n."""
    ordered = orders.orderBy(F.desc("peak_score"), "object_id", "opened_at")
    return ordered if n is None else ordered.limit(n)


def with_chronic_rank(orders: DataFrame, chronic: DataFrame) -> DataFrame:
    return orders.join(chronic.select("object_id", "chronic_rank"), "object_id", "left")
