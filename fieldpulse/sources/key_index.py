"""The ids of a stored table in buckets by hash, so that a merge reads the buckets of its batch and not all ids.

A bucket is a folder; its files are sorted by id and carry a Bloom filter of their ids. A merge learns the buckets of its
batch (at most as many numbers as there are buckets) and reads only those; the ids of a small batch also go into the scan,
which leaves out files and row groups by their filter and their smallest and largest id. The number of buckets follows the
number of ids: once they hold twice as many as meant, or too many small files, all ids are dealt anew into a new version.

An id enters the index after its row was stored. A job notes what it is about to add before it starts and when it is done;
if the note of the end is missing, the index is built anew from the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse.schemas import SENSORS
from fieldpulse.session import cut_lineage
from fieldpulse.sources.tables import append_rows, append_sensors, read_or_empty, rebalanced

BUCKET = "bucket"
BUCKET_IDS = 500_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 16_384
MOST_APPENDS = 100  # after so many appends the small files are put together
PUSHED_IDS = 500  # a batch of so many ids is looked up by value
_LAYOUT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("suffix", T.StringType()),
                        T.StructField("buckets", T.IntegerType())])
_NOTES = T.StructType([T.StructField("change", T.StringType()), T.StructField("suffix", T.StringType()),
                       T.StructField("state", T.StringType()), T.StructField("ids", T.LongType())])


class KeyIndex:
    def __init__(self, spark: SparkSession, path: str, key: str, bucket_ids: int = BUCKET_IDS, most_appends: int = MOST_APPENDS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.bucket_ids, self.most_appends = bucket_ids, most_appends

    def layout(self) -> tuple[str, int] | None:
        """Folder and number of buckets in force."""
        newest = read_or_empty(self.spark, f"{self.path}_layout", _LAYOUT).agg(
            F.max_by(F.struct("suffix", "buckets"), "seq").alias("l")).first()["l"]
        return (f"{self.path}-{newest['suffix']}", newest["buckets"]) if newest else None

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int")

    def stored(self, buckets: list[int] | None = None) -> DataFrame:
        """All ids, or those of some buckets, with the number of their bucket."""
        schema = T.StructType([T.StructField(self.key, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        found = self.layout()
        if found is None:
            return self.spark.createDataFrame([], schema)
        ids = self.spark.read.schema(schema).parquet(found[0])
        return ids if buckets is None else ids.where(F.col(BUCKET).isin(buckets))

    def candidates(self, batch: DataFrame) -> DataFrame:
        """Stored ids in the buckets of the batch: what a merge reads."""
        found = self.layout()
        if found is None:
            return self.stored()
        wanted = batch.select(F.col(self.key).cast("string").alias(self.key)).withColumn(BUCKET, self.bucket(found[1]))
        few = wanted.distinct().limit(PUSHED_IDS + 1).collect()
        if len(few) <= PUSHED_IDS:
            return self.stored(sorted({r[BUCKET] for r in few})).where(F.col(self.key).isin(sorted({r[0] for r in few if r[0] is not None})))
        return self.stored(sorted(r[BUCKET] for r in wanted.select(BUCKET).distinct().collect()))

    def insert_new(self, batch: DataFrame) -> DataFrame:
        """Rows of a de-duplicated batch whose id is not stored yet."""
        known = self.candidates(batch).select(self.key)
        return batch.join(known, batch[self.key].cast("string") == known[self.key], "left_anti")

    def _write(self, ids: DataFrame, folder: str, buckets: int, share: int) -> None:
        dealt = ids.select(F.col(self.key).cast("string").alias(self.key)).where(F.col(self.key).isNotNull()).withColumn(
            BUCKET, self.bucket(buckets))
        (rebalanced(dealt, BUCKET).sortWithinPartitions(BUCKET, self.key).write.mode("append").partitionBy(BUCKET)
         .option(f"parquet.bloom.filter.enabled#{self.key}", "true")
         .option(f"parquet.bloom.filter.expected.ndv#{self.key}", str(max(1000, share))).parquet(folder))

    def rebuild(self, ids: DataFrame) -> None:
        """Deal ``ids`` into a new version with as many buckets as they need, then make it the one in force."""
        suffix, count = uuid.uuid4().hex, ids.count()
        buckets = LEAST_BUCKETS
        while buckets < MOST_BUCKETS and buckets * self.bucket_ids < count:
            buckets *= 2
        self._write(ids, f"{self.path}-{suffix}", buckets, count // buckets)
        last = read_or_empty(self.spark, f"{self.path}_layout", _LAYOUT).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"]
        self._note(suffix, suffix, "done", count)
        append_rows(self.spark.createDataFrame([(last + 1, suffix, buckets)], _LAYOUT).coalesce(1), f"{self.path}_layout")

    def _note(self, change: str, suffix: str, state: str, ids: int) -> None:
        append_rows(self.spark.createDataFrame([(change, suffix, state, ids)], _NOTES).coalesce(1), f"{self.path}_notes")

    def _notes(self) -> DataFrame:
        found = self.layout()
        notes = read_or_empty(self.spark, f"{self.path}_notes", _NOTES)
        return notes.where(F.col("suffix") == (found[0].removeprefix(f"{self.path}-") if found else ""))

    def repair(self, table: Callable[[], DataFrame]) -> None:
        """Build the index where there is none yet, or where an addition did not come to its end."""
        open_ = self._notes().groupBy("change").agg(F.max(F.col("state") == "done").alias("done")).where("NOT done")
        if self.layout() is None or not open_.isEmpty():
            self.rebuild(table().select(self.key))

    def add(self, fresh: DataFrame, store: Callable[[], int]) -> int:
        """Store the rows by ``store`` and add their ids; ``fresh`` is a written table. The number of rows stored."""
        folder, buckets = self.layout()
        change, suffix = uuid.uuid4().hex, folder.removeprefix(f"{self.path}-")
        self._note(change, suffix, "open", 0)
        rows = store()
        self._write(fresh, folder, buckets, rows // buckets)
        self._note(change, suffix, "done", rows)
        total = self._notes().where("state = 'done'").agg(F.sum("ids").alias("ids"), F.count("*").alias("n")).first()
        if total["ids"] > 2 * self.bucket_ids * buckets and buckets < MOST_BUCKETS or total["n"] > self.most_appends:
            self.rebuild(self.stored().select(self.key))
        return rows


def merge_sensors(ids: KeyIndex, path: str, batch: DataFrame) -> DataFrame:
    """Append the readings of a written, de-duplicated batch that are not stored yet; the appended rows, as a written table."""
    ids.repair(lambda: read_or_empty(ids.spark, path, SENSORS))
    # the new rows are fixed before the store they were compared with grows
    fresh = cut_lineage(ids.insert_new(batch))
    ids.add(fresh, lambda: append_sensors(fresh, path))
    return fresh
