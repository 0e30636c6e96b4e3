"""Concordance and cumulative hazard over object-level rows.

Durations are whole days, so both work on tables of at most one row per day of the history (times the score buckets).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.functions.ranks import parts_for, with_bucket


BUCKET_ROWS = 100_000  # rows of one bucket, which one task sorts


def _inner_pairs(rows: pd.DataFrame) -> tuple[float, float]:
    """(pairs ranked right, pairs with equal score) inside one bucket: per event day, look the events up among the
    sorted scores of those who lasted longer."""
    right = equal = 0.0
    time = rows["duration"].to_numpy()
    failed = rows["event"].to_numpy().astype(bool)
    score = rows["score"].to_numpy()
    for day in np.unique(time[failed]):
        events = score[failed & (time == day)]
        later = np.sort(score[(time > day) | ((time == day) & ~failed)])
        low = np.searchsorted(later, events, "left")
        right += low.sum()
        equal += (np.searchsorted(later, events, "right") - low).sum()
    return right, equal


def c_index(objects: DataFrame, score: str = "score", parts: int | None = None) -> DataFrame:
    """One row: share of comparable pairs in which the earlier failure has the higher score, ties counting half.

    A pair is comparable when the one observed shorter failed; of equal durations a failure is comparable with one
    that did not fail. No pairs are formed: scores fall into buckets, pairs across buckets come from running counts of
    a (bucket, duration) table, pairs inside a bucket are counted by sorting that bucket. The number of cuts follows the
    number of rows, so a bucket stays small; a score shared by many has a bucket of its own that nobody sorts.
    """
    rows = objects.select("duration", F.col("event").cast("int").alias("event"),
                          F.col(score).cast("double").alias("score")).where(F.col("score").isNotNull())
    rows = with_bucket(rows, "score", parts or parts_for(rows, BUCKET_ROWS))

    cells = rows.groupBy("_bucket", "duration").agg(
        F.sum("event").alias("events"), F.count(F.lit(1)).alias("alive"), F.sum(1 - F.col("event")).alias("quiet"))
    # every bucket needs an entry at every event day that occurs anywhere
    top = rows.agg(F.max("_bucket")).scalar()
    days = rows.where("event = 1").select("duration").distinct().withColumn("_top", top)
    zero = F.lit(0).cast("bigint")
    blank = days.select(F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("_bucket"), "duration",
                        zero.alias("events"), zero.alias("alive"), zero.alias("quiet"))
    grid = cells.unionByName(blank).groupBy("_bucket", "duration").agg(
        F.sum("events").alias("events"), F.sum("alive").alias("alive"), F.sum("quiet").alias("quiet"))
    after = Window.partitionBy("_bucket").orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("later", F.coalesce(F.sum("alive").over(after), F.lit(0)) + F.col("quiet"))
    at_day = Window.partitionBy("duration")
    lower = at_day.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumns({"_lower": F.coalesce(F.sum("later").over(lower), F.lit(0)),
                             "_all": F.sum("later").over(at_day)})
    events = F.col("events").cast("double")
    # odd buckets hold a single score: everything comparable inside is a tie
    ties = F.when(F.col("_bucket") % 2 == 1, events * F.col("later")).otherwise(F.lit(0.0))
    across = grid.agg(F.sum(events * F.col("_lower")).alias("right"), F.sum(ties).alias("equal"),
                      F.sum(events * F.col("_all")).alias("pairs"))

    def count_inside(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        right, equal = _inner_pairs(part)
        return pd.DataFrame({"right": [right], "equal": [equal]})

    inner = rows.where("_bucket % 2 = 0").groupBy("_bucket").applyInPandas(count_inside, "right double, equal double")
    total = across.unionByName(inner, allowMissingColumns=True).agg(
        F.sum("right").alias("right"), F.sum("equal").alias("equal"), F.sum("pairs").alias("pairs"))
    return total.select(F.try_divide(F.col("right") + F.col("equal") / 2, F.col("pairs")).alias("c_index"))


def cumulative_hazard(objects: DataFrame) -> DataFrame:
    """Failures, objects at risk and the summed hazard per duration."""
    days = objects.groupBy("duration").agg(F.sum("event").alias("events"), F.count(F.lit(1)).alias("n"))
    longer = Window.partitionBy(F.lit(1)).orderBy(F.desc("duration")).rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.partitionBy(F.lit(1)).orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("at_risk", F.sum("n").over(longer))
    return days.withColumn("hazard", F.sum(F.col("events") / F.col("at_risk")).over(so_far)).drop("n")


def event_residual(objects: DataFrame) -> DataFrame:
    """Event minus the hazard expected by its duration: high for early failures, negative for long survivors."""
    expected = cumulative_hazard(objects).select("duration", "hazard")
    return objects.join(expected, "duration").withColumn("residual", F.col("event") - F.col("hazard")).drop("hazard")
