"""The index of ids and the rebuild of touched months."""

import random

import pytest
from pyspark.sql import functions as F

from fieldpulse.plans import jobs
from fieldpulse.plans.jobs import Store, ingest_staged, rebuild_features, upsert_weather
from fieldpulse.schemas import FEATURES, SENSORS, WEATHER
from fieldpulse.sources import monthly
from fieldpulse.sources import tables as T
from fieldpulse.sources.key_index import BUCKET, KeyIndex, merge_sensors

T0 = 1767225600  # 2026-01-01


def readings(spark, rows):
    """(record id, object, recorded[, measured]) rows with channels that depend on them."""
    data = [(str(r[0]), r[1], r[3] if len(r) > 3 else r[2], 60.0 + r[2] % 7, 40.0, 6.0 + (r[2] // 900) % 5 / 10, 4.0, r[2]) for r in rows]
    return spark.createDataFrame(data, SENSORS)


def ids_of(frame):
    return sorted(r[0] for r in frame.select("record_id").collect())


# ids --------------------------------------------------------------------------------------------------------------------


def test_merge_through_the_index_adds_only_unseen_ids(spark, tmp_path):
    ids, path = KeyIndex(spark, f"{tmp_path}/s_ids", "record_id"), f"{tmp_path}/s"
    first = merge_sensors(ids, path, readings(spark, [(i, "A", T0 + i) for i in range(30)]))
    again = merge_sensors(ids, path, readings(spark, [(i, "A", T0 + i) for i in range(20, 50)]))
    assert ids_of(first) == sorted(map(str, range(30))) and ids_of(again) == sorted(map(str, range(30, 50)))
    assert ids_of(T.read_or_empty(spark, path, SENSORS)) == ids_of(ids.stored()) == sorted(map(str, range(50)))
    assert merge_sensors(ids, path, readings(spark, [])).count() == 0


@pytest.mark.parametrize("size", [3, 700])
def test_a_merge_reads_only_the_buckets_of_its_batch(spark, tmp_path, size):
    ids = KeyIndex(spark, f"{tmp_path}/ids", "record_id", bucket_ids=40)
    ids.rebuild(spark.range(20_000).select(F.col("id").cast("string").alias("record_id")))
    folder, buckets = ids.layout()
    assert buckets == 512 and ids.stored().select(BUCKET).distinct().count() == buckets
    batch = spark.range(size).select((F.col("id") * 29 + 19_990).cast("string").alias("record_id"))
    read = ids.candidates(batch)
    files = read.select(F.input_file_name().alias("f")).distinct().count()
    touched = batch.select(ids.bucket(buckets).alias("b")).distinct().count()
    assert files <= touched <= min(size, buckets) and "PartitionFilters: [bucket" in read._jdf.queryExecution().toString()
    if size == 3:
        assert "PushedFilters: [In(record_id" in read._jdf.queryExecution().toString() or "PushedFilters: [IsNotNull" in read._jdf.queryExecution().toString()
    assert ids.insert_new(batch).count() == size - len([i for i in range(size) if i * 29 + 19_990 < 20_000])


def test_files_of_the_index_carry_a_bloom_filter(spark, tmp_path):
    ids = KeyIndex(spark, f"{tmp_path}/ids", "record_id")
    ids.rebuild(spark.range(4000).select(F.col("id").cast("string").alias("record_id")))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [r.f for r in ids.stored().select(F.input_file_name().alias("f")).distinct().collect()]
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(files[0]), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    assert reader.getFooter().getBlocks().get(0).getColumns().get(0).getBloomFilterOffset() > 0
    reader.close()


def test_index_grows_and_gathers_small_files(spark, tmp_path):
    ids, path = KeyIndex(spark, f"{tmp_path}/ids", "record_id", bucket_ids=10, most_appends=4), f"{tmp_path}/s"
    seen = set()
    for k in range(7):
        rows = readings(spark, [(i, "A", T0 + i) for i in range(k * 60, k * 60 + 90)])
        fresh = ids_of(merge_sensors(ids, path, rows))
        assert fresh == sorted(str(i) for i in range(k * 60, k * 60 + 90) if str(i) not in seen)
        seen |= set(fresh)
    assert ids.layout()[1] > 16 and ids_of(ids.stored()) == sorted(seen)


def test_an_addition_that_broke_off_is_repaired(spark, tmp_path):
    ids, path = KeyIndex(spark, f"{tmp_path}/ids", "record_id"), f"{tmp_path}/s"
    merge_sensors(ids, path, readings(spark, [(1, "A", T0)]))
    fresh = readings(spark, [(2, "A", T0)])

    def store_and_fail():
        T.append_sensors(fresh, path)
        raise OSError("lost")

    with pytest.raises(OSError):
        ids.add(fresh, store_and_fail)
    assert merge_sensors(ids, path, readings(spark, [(2, "A", T0), (3, "A", T0)])).count() == 1
    assert ids_of(T.read_or_empty(spark, path, SENSORS)) == ["1", "2", "3"]


def test_store_without_an_index_gets_one(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    T.append_sensors(readings(spark, [(1, "A", T0), (2, "A", T0)]), store.path("sensors"))
    for i, rows in enumerate(([(2, "A", T0), (3, "A", T0)], [(3, "A", T0), (3, "A", T0), (4, "B", T0)])):
        readings(spark, rows).write.parquet(f"{tmp_path}/staged{i}")
    stats = ingest_staged(store, [f"{tmp_path}/staged0", f"{tmp_path}/staged1"]).first()
    assert tuple(stats) == (2, 1) and ids_of(store.sensors()) == ["1", "2", "3", "4"]


# months -----------------------------------------------------------------------------------------------------------------


def test_months_switch_together_and_others_stay(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "object_id string, date date, x double"
    kind = spark.createDataFrame([], schema).schema

    def rows(*days):
        return spark.createDataFrame([("A", d, float(x)) for d, x in days], "object_id string, date string, x double").withColumn(
            "date", F.col("date").cast("date"))

    def content(months=None):
        return sorted((str(r.date), r.x) for r in monthly.read_months(spark, path, kind, months).collect())

    assert content() == []
    monthly.replace_months(rows(("2026-01-05", 1), ("2026-02-05", 2), ("2026-03-05", 3)), path, ["2026-01", "2026-02", "2026-03"])
    before = monthly.read_months(spark, path, kind)
    monthly.replace_months(rows(("2026-02-06", 4), ("2026-01-01", 9)), path, ["2026-02", "2026-03"])
    assert content() == [("2026-01-05", 1.0), ("2026-02-06", 4.0)]
    assert content(["2026-01"]) == [("2026-01-05", 1.0)] and before.count() == 3
    with pytest.raises(Exception, match="lost"):
        monthly.replace_months(rows(("2026-01-05", 7)).withColumn("x", F.raise_error(F.lit("lost")).cast("double")), path, ["2026-01"])
    assert content() == [("2026-01-05", 1.0), ("2026-02-06", 4.0)]
    plan = monthly.read_months(spark, path, kind, ["2026-01"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan


def history(seed: int):
    """Four months of readings, a few measured long before they are recorded, some measured twice."""
    rng, rows = random.Random(seed), []
    for i in range(1500):
        recorded = T0 + rng.randrange(120 * 86400)
        delay = rng.choice([0] * 12 + [900, 86400, 5 * 86400]) if i % 40 else 33 * 86400
        rows.append((i, f"o{rng.randrange(4)}", recorded, (recorded - delay) // 3600 * 3600))
    return rows


def matrix_rows(frame):
    return {(r.object_id, r.date): tuple(None if r[c] is None else round(r[c], 6) for c in FEATURES) for r in frame.collect()}


def weather(spark, first, n, shift=0.0):
    return spark.range(n).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("date"),
                                 *[(F.col("id") % 11 + shift).cast("double").alias(c) for c in WEATHER.names[1:]], F.col("id").alias("seq"))


def test_builds_by_touched_months_equal_a_whole_one(spark, tmp_path):
    rows = sorted(history(1), key=lambda r: r[2])
    late, rows = rows[300:360], rows[:300] + rows[360:]
    store = Store(spark, f"{tmp_path}/grown")
    upsert_weather(store, weather(spark, "2026-01-01", 130), "seq")
    for part in (rows[:900], rows[900:1200], rows[1200:], late):
        T.append_sensors(readings(spark, part), store.path("sensors"))
        rebuild_features(store, 2026)
    whole = Store(spark, f"{tmp_path}/whole")
    upsert_weather(whole, weather(spark, "2026-01-01", 130), "seq")
    T.append_sensors(readings(spark, rows + late), whole.path("sensors"))
    stats = rebuild_features(whole, 2026).first()
    assert matrix_rows(store.matrix()) == matrix_rows(whole.matrix()) and stats["object_days"] == store.matrix().count() > 300
    # warmer days change the curves from there on, without a look at the readings
    changed = weather(spark, "2026-03-10", 5, 3.0)
    upsert_weather(store, changed, "seq")
    upsert_weather(whole, changed, "seq")
    rebuild_features(store, 2026)
    rebuild_features(whole, 2026, whole=True)
    assert matrix_rows(store.matrix()) == matrix_rows(whole.matrix())


def test_a_new_day_reads_and_writes_its_months_only(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    T.append_sensors(readings(spark, [(d * 10 + h, "A", T0 + d * 86400 + h * 3600) for d in range(110) for h in range(6)]), store.path("sensors"))
    rebuild_features(store, 2026)
    before = monthly.current_months(spark, store.path("matrix"))
    T.append_sensors(readings(spark, [(9000 + h, "A", T0 + 110 * 86400 + h * 3600) for h in range(6)]), store.path("sensors"))
    seen = []
    real = jobs.features.build_days
    monkeypatch.setattr(jobs.features, "build_days", lambda df, *a: seen.append(df) or real(df, *a))
    rebuild_features(store, 2026)
    read = {r[T.MONTH] for r in seen[0].select(T.MONTH).distinct().collect()}
    files = [r.f for r in seen[0].select(F.input_file_name().alias("f")).distinct().collect()]
    assert read == {"2026-04"} and all("event_month=2026-04" in f for f in files)
    after = monthly.current_months(spark, store.path("matrix"))
    assert {m for m in after if after[m] != before.get(m)} == {"2026-04"}
    assert store.matrix().count() == 111
    rebuild_features(store, 2026)  # nothing new
    assert seen[1].isEmpty() and monthly.current_months(spark, store.path("matrix")) == after
