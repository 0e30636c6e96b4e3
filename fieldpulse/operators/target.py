"""Time to failure, temporal split and the object-level survival table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.functions.values import DAY, day_start, epoch_date
from fieldpulse.operators.cleaning import pick_row
from fieldpulse.schemas import BASELINE_DAYS, HORIZON_DAYS, MERGE_GAP_DAYS

SPLITS = ["train", "val", "test"]


def within_horizon(ttf: Column | str = "t_to_failure", days: int = HORIZON_DAYS) -> Column:
    """1 when a failure starts within the horizon, else 0."""
    ttf = F.col(ttf) if isinstance(ttf, str) else ttf
    return F.coalesce(ttf <= days * 24, F.lit(False)).cast("int")


def add_target(panel: DataFrame, incidents: DataFrame, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Hours from the end of each day to the object's next incident at or after the start of the day.

    Incidents are first reduced to the earliest one per object and day, so that an as-of lookup walks over at most one
    entry per calendar day however many incidents an object has. An incident inside the day counts as 0.01 hours.
    """
    moments = incidents.dropna(subset=["object_id", "incident_ts"]).groupBy(
        "object_id", epoch_date("incident_ts").alias("_day")).agg(F.min("incident_ts").alias("_incident"))
    keyed = panel.withColumns({"_day": F.col("date"), "_row": F.lit(True)})
    both = keyed.unionByName(moments, allowMissingColumns=True)
    # days and incident days share the order; an incident of the same day belongs to the frame
    ahead = Window.partitionBy("object_id").orderBy(F.unix_date("_day")).rangeBetween(
        Window.currentRow, Window.unboundedFollowing)
    looked = both.withColumn("_next", F.min("_incident").over(ahead)).where("_row")
    hours = (F.col("_next") - (day_start("date") + DAY)) / 3600.0
    ttf = F.when(F.col("_next").isNotNull(), F.when(hours > 0, hours).otherwise(F.lit(0.01)))
    out = looked.select(*panel.columns, ttf.alias("t_to_failure"))
    return out.withColumn("y", within_horizon("t_to_failure", horizon_days))


def default_cutoffs(panel: DataFrame) -> DataFrame:
    """One row (val_start, test_start): test is the last month holding its 28th day, val the month before."""
    last = panel.agg(F.max("date").alias("last"))
    month = F.trunc("last", "MM").cast("date")
    test = F.when(F.day("last") < 28, F.add_months(month, -1)).otherwise(month)
    return last.select(F.add_months(test, -1).alias("val_start"), test.alias("test_start"))


def temporal_split(panel: DataFrame, val_start: str | None = None, test_start: str | None = None) -> DataFrame:
    """train < val_start <= val < test_start <= test, by date alone."""
    if val_start is not None and test_start is not None and val_start >= test_start:
        raise ValueError("val_start must come before test_start")
    auto = default_cutoffs(panel)
    val = F.lit(val_start).cast("date") if val_start else auto.select("val_start").scalar()
    test = F.lit(test_start).cast("date") if test_start else auto.select("test_start").scalar()
    split = (F.when(F.col("_val") >= F.col("_test"), F.raise_error(F.lit("val_start must come before test_start")))
             .when(F.col("date") < F.col("_val"), "train").when(F.col("date") < F.col("_test"), "val")
             .otherwise("test"))
    return panel.withColumns({"_val": val, "_test": test}).withColumn("split", split).drop("_val", "_test")


def split_windows(panel: DataFrame) -> DataFrame:
    """First and last date of every split, also as text 'from..to'."""
    return panel.groupBy("split").agg(F.min("date").alias("date_from"), F.max("date").alias("date_to")).withColumn(
        "window", F.concat_ws("..", F.col("date_from").cast("string"), F.col("date_to").cast("string")))


def merge_events(days: Column, gap: int = MERGE_GAP_DAYS) -> Column:
    """Of an array of dates keep those more than ``gap`` days after the last kept one."""
    return F.aggregate(
        F.array_sort(F.array_distinct(days)), F.array().cast("array<date>"),
        lambda kept, d: F.when(
            (F.size(kept) == 0) | (F.date_diff(d, F.element_at(kept, -1)) > gap), F.concat(kept, F.array(d)),
        ).otherwise(kept))


def _fail_day() -> Column:
    """The day reached by adding the hours to failure, whole seconds again, to the row's date."""
    return epoch_date(day_start("date") + F.round(F.col("t_to_failure") * 3600).cast("bigint"))


def failure_days(panel: DataFrame) -> DataFrame:
    """Distinct (object, fail_day) implied by the hours to failure."""
    return panel.where(F.col("t_to_failure").isNotNull()).select("object_id", _fail_day().alias("fail_day")).distinct()


def failure_events(panel: DataFrame, gap: int = MERGE_GAP_DAYS) -> DataFrame:
    """Failure days per object after merging close ones (an object has at most one entry per calendar day)."""
    days = failure_days(panel).groupBy("object_id").agg(F.collect_list("fail_day").alias("_days"))
    return days.select("object_id", F.explode(merge_events(F.col("_days"), gap)).alias("fail_day"))


def object_level(panel: DataFrame, features: list[str], baseline_days: int = BASELINE_DAYS) -> DataFrame:
    """One row per object: time to its first failure and median features of its first days, all before that failure.

    The first kept failure day is always the earliest, so merging close events does not change it. Everything per
    object is a handful of window aggregates over its own days; the medians then see at most ``baseline_days`` rows.
    """
    cols = [c for c in features if c in panel.columns]
    whole = Window.partitionBy("object_id")
    event = F.when(F.col("t_to_failure").isNotNull(), _fail_day())
    framed = panel.withColumns({
        "_entry": F.min("date").over(whole), "_last": F.max("date").over(whole), "_event": F.min(event).over(whole)})
    upper = F.least(F.date_add("_entry", baseline_days), F.col("_event"))
    # nothing before the event: the first day stands in
    kept = framed.where((F.col("date") < upper) | (F.col("date") == F.col("_entry")))
    split = F.min_by("split", "date") if "split" in panel.columns else F.lit("train")
    out = kept.groupBy("object_id").agg(
        split.alias("split"), F.max("_entry").alias("_entry"), F.max("_last").alias("_last"),
        F.max("_event").alias("_event"), *[F.percentile(c, 0.5).alias(c) for c in cols])
    days = F.date_diff(F.coalesce("_event", "_last"), F.col("_entry")).cast("double")
    return out.select("object_id", "split", F.greatest(days, F.lit(1.0)).alias("duration"),
                      F.col("_event").isNotNull().cast("int").alias("event"), *cols)


def first_rows(panel: DataFrame) -> DataFrame:
    """First day of every object."""
    return pick_row(panel, ["object_id"], ["date"])
