"""Batch jobs over stored tables: upload, feature rebuild, labelling."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse.operators import cleaning, features, labels, merge
from fieldpulse.schemas import (
    DAY_HOURS, FUZZY_THRESHOLD, INCIDENTS, MATRIX, NIGHT_HOURS, OBJECTS, RESOLUTION, SENSORS, WEATHER, schema_version,
)
from fieldpulse.session import cut_lineage
from fieldpulse.sources import landing, monthly, tables
from fieldpulse.sources.key_index import KeyIndex, merge_sensors
from fieldpulse.sources.tables import MONTH


class Store:
    """Where the tables of one deployment live."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def current(self, name: str) -> str:
        """Path of the newest version of a table that is replaced as a whole."""
        return tables.current_path(self.spark, self.path(name))

    def sensors(self) -> DataFrame:
        return tables.read_or_empty(self.spark, self.path("sensors"), SENSORS)

    def objects(self) -> DataFrame:
        return tables.read_or_empty(self.spark, self.current("objects"), OBJECTS)

    def incidents(self) -> DataFrame:
        return tables.read_or_empty(self.spark, self.path("incidents"), INCIDENTS)

    def weather(self) -> DataFrame:
        return tables.read_or_empty(self.spark, self.current("weather"), WEATHER)

    def matrix(self) -> DataFrame:
        """The stored feature matrix; empty with all columns of the contract before the first rebuild."""
        return monthly.read_months(self.spark, self.path("matrix"), MATRIX)

    def ids(self, name: str, key: str) -> KeyIndex:
        """Index of the ids of a table that only grows."""
        return KeyIndex(self.spark, self.path(f"{name}_ids"), key)

    def resolutions(self) -> DataFrame:
        return tables.read_or_empty(self.spark, self.path("resolutions"), RESOLUTION)


def ingest_upload(store: Store, sources: list[DataFrame]) -> DataFrame:
    """Normalise, clean and append an upload; one row of statistics. Repeating an upload adds nothing."""
    found = landing.union_sources(sources)
    empty = store.spark.createDataFrame([], SENSORS)
    if found is None:
        return merge.ingest_stats(empty, empty, empty)
    batch, meta = (cut_lineage(df) for df in found)
    objects = cut_lineage(merge.insert_new(store.objects(), meta, "object_id"))
    fresh = merge_sensors(store.ids("sensors", "record_id"), store.path("sensors"), batch)
    tables.append_rows(objects, store.current("objects"))
    return merge.ingest_stats(batch, fresh, objects)


def ingest_staged(store: Store, paths: list[str]) -> DataFrame:
    """Merge the staged files of one upload, already normalised, in one go; (inserted, skipped_duplicates)."""
    staged = tables.read_batches(store.spark, paths, SENSORS)
    batch = cut_lineage(cleaning.dedup_records(cleaning.clean_ingest(staged)))
    return merge.merge_stats(batch, merge_sensors(store.ids("sensors", "record_id"), store.path("sensors"), batch))


def add_incidents(store: Store, incidents: DataFrame) -> DataFrame:
    """Append unseen incidents; (inserted, skipped_duplicates)."""
    batch = cut_lineage(incidents.dropDuplicates(["incident_id"]))
    fresh = cut_lineage(merge.insert_new(store.incidents(), batch, "incident_id"))
    tables.append_rows(fresh, store.path("incidents"))
    return merge.merge_stats(batch, fresh)


#: Which changes a series of builds has taken in; a build of all months starts a new series.
_DONE = T.StructType([T.StructField("change", T.StringType()), T.StructField("series", T.StringType()),
                      T.StructField("settings", T.StringType()), T.StructField("seq", T.LongType())])


def _overlapping(ranges: dict[str, tuple[int, int]], with_: list[tuple[int, int]]) -> set[str]:
    return {m for m, (low, high) in ranges.items() if any(low <= b and a <= high for a, b in with_)}


def months_to_rebuild(changes: DataFrame, pending: DataFrame) -> tuple[set[str], set[str]]:
    """Months whose days may differ from what is stored, and the months to read for them: a row per month is looked at.

    A reading counts for the month of its earliest record, and equal measurements may be recorded in several months. A month
    is affected if it holds new rows, or measurements of a time at which new rows were measured; and it needs the months that
    hold measurements of the times of its own.
    """
    def by_month(df: DataFrame) -> dict[str, tuple[int, int]]:
        rows = df.where(F.col("first_measured").isNotNull()).groupBy(MONTH).agg(
            F.min("first_measured").alias("low"), F.max("last_measured").alias("high")).collect()
        return {r[MONTH]: (r["low"], r["high"]) for r in rows}

    ranges, new = by_month(changes), by_month(pending)
    affected = {*new, *_overlapping(ranges, list(new.values()))}
    return affected, affected | _overlapping(ranges, [ranges[m] for m in affected if m in ranges])


def rebuild_features(store: Store, min_year: int, night: tuple[int, int] = NIGHT_HOURS, day: tuple[int, int] = DAY_HOURS,
                     whole: bool = False) -> DataFrame:
    """Bring the stored matrix up to date from the first year on; one row of statistics.

    Readings are read for the months that new rows touch, and rolled up to stored days. Features look back without a limit, so
    they are computed anew from the stored days, but written only from the first touched month on. The first build, ``whole``
    and other settings than those of the last build take all months.
    """
    settings = "|".join(map(str, (min_year, night, day, schema_version())))
    spark, first = store.spark, f"{min_year:04d}"
    sensors, weather = store.sensors(), store.weather()
    changes = tables.read_or_empty(spark, store.path("sensors_changes"), tables.CHANGES)
    warmer = tables.read_or_empty(spark, store.path("weather_changes"), tables.CHANGES)
    done = tables.read_or_empty(spark, store.path("matrix_done"), _DONE)
    last = done.agg(F.max_by(F.struct("series", "settings", "seq"), "seq").alias("l")).first()["l"]
    everything = whole or last is None or last["settings"] != settings
    series, seq = uuid.uuid4().hex if everything else last["series"], last["seq"] + 1 if last else 0
    noted = changes.select("change").unionByName(warmer.select("change")).distinct()
    pending = cut_lineage(noted.join(done.where(F.col("series") == series), "change", "left_anti"))
    days_path, matrix_path = store.path("days"), store.path("matrix")
    if everything:
        affected = {r[MONTH] for r in sensors.select(MONTH).distinct().collect()} if MONTH in sensors.columns else set()
        affected = {m for m in affected if m >= first} | set(monthly.current_months(spark, days_path))
        needed, oldest = affected, ""
    else:
        affected, needed = months_to_rebuild(changes, changes.join(pending, "change"))
        affected = {m for m in affected if m >= first}
        turned = warmer.join(pending, "change").agg(F.min(MONTH).alias("m")).first()["m"]
        oldest = min([*affected, *([turned] if turned else [])], default=None)
    read = sensors.where(F.col(MONTH).isin(sorted(needed))) if needed and MONTH in sensors.columns else sensors.limit(0)
    days = features.build_days(read, min_year, night, day)
    monthly.replace_months(days, days_path, sorted(affected))
    if oldest is not None:
        matrix = features.matrix_of_days(monthly.read_months(spark, days_path, days.schema).drop(MONTH), weather)
        monthly.replace_months(matrix, matrix_path, sorted(m for m in monthly.current_months(spark, days_path) if m >= oldest))
    # a row even if nothing was pending: it names the settings of the build
    taken = pending.unionByName(spark.createDataFrame([(series,)], pending.schema)).select(
        "change", F.lit(series).alias("series"), F.lit(settings).alias("settings"), F.lit(seq).cast("long").alias("seq"))
    tables.append_rows(taken.coalesce(1), store.path("matrix_done"))
    return features.rebuild_stats(store.matrix(), sensors, weather, schema_version())


def label_upload(store: Store, journals: dict[str, DataFrame], threshold: int = FUZZY_THRESHOLD,
                 extraction: Column | None = None) -> DataFrame:
    """Journal files to published incidents; one row of the label funnel. Known claims are not resolved again."""
    if not journals:
        raise FileNotFoundError("no journal files")
    journal = merge.union_all([landing.cast_journal(df, name) for name, df in journals.items()])
    claims, other = (cut_lineage(df) for df in labels.route_journal(journal))
    catalog = labels.eligible_catalog(store.objects())
    resolved, fresh = (cut_lineage(df) for df in labels.resolve(claims, store.resolutions(), catalog, threshold, extraction))
    tables.append_rows(fresh, store.path("resolutions"))
    incidents = cut_lineage(labels.to_incidents(claims, resolved))
    published = cut_lineage(merge.insert_new(store.incidents(), incidents, "incident_id"))
    tables.append_rows(published, store.path("incidents"))
    repeated = incidents.join(published.select("incident_id"), "incident_id", "left_anti")
    return labels.label_stats(claims, other, resolved, published, repeated)


def upsert_weather(store: Store, rows: DataFrame, order: str) -> DataFrame:
    """Last write wins per day; (added, updated)."""
    rows = cut_lineage(rows)
    stored = store.weather()  # this version stays when the table is replaced
    stats = merge.upsert_stats(stored, rows, "date")
    tables.note_changes(rows.select(F.date_format("date", "yyyy-MM").alias(MONTH), F.lit(None).cast("long").alias("ts_measurement")),
                        store.path("weather"))
    tables.replace_table(merge.upsert_latest(stored, rows, "date", order), store.path("weather"))
    return stats


def update_objects(store: Store, updates: DataFrame) -> None:
    """Overwrite the supplied fields of stored objects."""
    tables.replace_table(merge.apply_updates(store.objects(), updates), store.path("objects"))
