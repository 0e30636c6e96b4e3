from pyspark.sql import functions as F

from conftest import day
from fieldpulse.operators import store as S
from fieldpulse.plans.jobs import Store, rebuild_features
from fieldpulse.schemas import FEATURES, OBJECTS, SENSORS, WEATHER
from fieldpulse.sources import tables as T

T0 = 1767225600


def sensors(spark, rows):
    return spark.createDataFrame([(str(i), o, t, 60.0, float("nan"), 6.0, 4.0, t) for i, (o, t) in enumerate(rows)], SENSORS)


def test_never_written_tables_are_empty(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    assert store.sensors().columns == SENSORS.names and store.sensors().count() == 0
    assert S.store_health(store.sensors()).first()["sensors_count"] == 0
    assert T.slice_matrix(spark.createDataFrame([], "object_id string, date date")).count() == 0


def test_stored_nan_reads_back_as_null(spark, tmp_path):
    path = str(tmp_path / "s")
    sensors(spark, [("A", T0)]).withColumn("record_id", F.col("record_id").cast("bigint")).write.parquet(path)
    row = T.read_or_empty(spark, path, SENSORS).first()
    assert row["t_return"] is None and row["record_id"] == "0"


def test_ranges_are_inclusive_and_pushed_down(spark, tmp_path):
    path = str(tmp_path / "s")
    sensors(spark, [("A", T0 + i) for i in range(5)] + [("B", T0)]).write.parquet(path)
    out = S.sensors_between(spark.read.parquet(path), "A", T0 + 1, T0 + 3)
    assert sorted(r["ts_recorded"] - T0 for r in out.collect()) == [1, 2, 3]
    plan = out._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts_recorded" in plan and "EqualTo(object_id,A)" in plan


def test_ranges_prune_months(spark, tmp_path):
    path = str(tmp_path / "s")
    T.append_sensors(sensors(spark, [("A", T0 + i * 20 * 86400) for i in range(5)]), path)
    out = S.sensors_between(T.read_or_empty(spark, path, SENSORS), "A", T0 + 86400, T0 + 45 * 86400)
    assert sorted((r["ts_recorded"] - T0) // 86400 for r in out.collect()) == [20, 40]
    assert "PartitionFilters: [isnotnull(event_month" in out._jdf.queryExecution().toString()


def test_pages_and_totals(spark):
    rows, total = S.page(sensors(spark, [("A", T0 + i) for i in range(10)]), ["ts_recorded", "record_id"], 7, 5)
    assert [r["ts_recorded"] - T0 for r in rows.collect()] == [7, 8, 9] and total.first()["total"] == 10


def test_calendar_and_neighbours(spark):
    df = sensors(spark, [("A", T0), ("A", T0 + 86399), ("A", T0 + 3 * 86400), ("B", T0 + 86400)])
    assert sorted(r["date"] for r in S.object_calendar(df, "A").collect()) == [day(0), day(3)]
    row = S.neighbour_days(df).where((F.col("object_id") == "A") & (F.col("date") == F.lit(day(3)))).first()
    assert (row["prev_day"], row["next_day"]) == (day(0), None)
    exact = {r["date"]: r["objects_count"] for r in S.coverage_summary(df).collect()}
    assert exact == {day(0): 1, day(1): 1, day(3): 1} == {r["date"]: r["objects_count"] for r in S.coverage_summary(df, approximate=True).collect()}


def test_unknown_objects_of_a_day_keep_their_id(spark):
    meta = spark.createDataFrame([("A", "t", "f", "n", "m", "r"), ("C", "t", "f", "n", "m", "r")], OBJECTS)
    out = {r["object_id"]: r["rso"] for r in S.objects_on_day(sensors(spark, [("A", T0), ("B", T0)]), meta, str(day(0))).collect()}
    assert out == {"A": "r", "B": None}


def test_search_is_case_insensitive(spark):
    meta = spark.createDataFrame([("A", None, "ЦТП", "Котельная О'Нил", "Химки", None), ("B", None, "ЦТП", "x", "Химки", None)], OBJECTS)
    assert [r["object_id"] for r in S.search_objects(meta, "Химки", "ЦТП", "о'нил").collect()] == ["A"]
    assert S.object_by_id(meta, "B").count() == 1 and S.object_by_id(meta, "Z").count() == 0


def test_midnight_belongs_to_both_days(spark):
    df = sensors(spark, [("A", T0), ("A", T0 + 60), ("A", T0 + 86400), ("B", T0)])
    wanted = spark.createDataFrame([("A", day(0)), ("A", day(1))], "object_id string, date date")
    out = sorted((r["date"], r["ts_recorded"] - T0) for r in S.day_profiles(df, wanted).collect())
    assert out == [(day(0), 0), (day(0), 60), (day(0), 86400), (day(1), 86400)]
    assert S.day_profiles(df, wanted, 1).count() == 2


def test_profile_limit_is_cut_before_the_shuffle(spark):
    wanted = spark.createDataFrame([("A", day(0))], "object_id string, date date")
    plan = S.day_profiles(sensors(spark, [("A", T0)]), wanted, 100)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rebuild_and_slice(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(o, T0 + d * 86400 + h * 3600) for o in "AB" for d in range(40) for h in range(3)]
    T.append_sensors(sensors(spark, rows), store.path("sensors"))
    T.append_rows(spark.createDataFrame([(day(0), 1.0, 0.0, 2.0, 17.0)], WEATHER), store.path("weather"))
    assert store.matrix().columns == ["object_id", "date", *FEATURES] and store.matrix().isEmpty()
    stats = rebuild_features(store, 2025).first()
    assert (stats["object_days"], stats["objects"], stats["sensor_rows"], stats["weather_days"]) == (80, 2, 240, 1)
    out = T.slice_matrix(store.matrix(), str(day(2)), str(day(4)), ["A"])
    assert out.columns == ["object_id", "date", *FEATURES] and out.count() == 3
    assert store.matrix().count() == 80
    assert rebuild_features(store, 2027).first()["object_days"] == 0 and store.matrix().isEmpty()


def test_pages_after_the_last_row_seen(spark):
    rows = sensors(spark, [("A", T0 + i // 3) for i in range(20)])
    keys, last, seen = ["ts_recorded", "record_id"], (T0 - 1, ""), []
    while got := [(r["ts_recorded"], r["record_id"]) for r in S.page_after(rows, keys, last, 6).collect()]:
        seen += got
        last = got[-1]
    assert seen == sorted((r["ts_recorded"], r["record_id"]) for r in rows.collect())
