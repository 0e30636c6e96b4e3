import pytest
from pyspark.sql import functions as F

from fieldpulse.operators import cleaning as C
from fieldpulse.operators import merge as M
from fieldpulse.plans.jobs import Store, add_incidents, ingest_upload, update_objects, upsert_weather
from fieldpulse.schemas import INCIDENTS, OBJECTS, SENSORS
from fieldpulse.sources import landing as L
from fieldpulse.sources import tables as T

A_COLUMNS = ["ID", "Дата и время показателей", "T пр", "T обр", "P пр", "P обр", "Дата и время записи", "ID объекта",
             "Тип объекта", "Котельная/ЦТП", "Наименование объекта", "Муниципалитет", "РСО"]


def layout_a(spark, ids, hour=0, **change):
    rows = []
    for i in ids:
        row = dict(zip(A_COLUMNS, [f"R{i}", f"2025-11-01 {(hour + i) % 24:02d}:00:00", str(60 + i % 9), "50", "6", "4",
                                   f"2025-11-01 {(hour + i) % 24:02d}:01:00", f"OBJ_{i % 2 + 1}", "ТИ", "ЦТП", "ЦТП-1",
                                   "Химки", "РСО"]))
        rows.append(tuple({**row, **change}.values()))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in A_COLUMNS))


def layout_b(spark, n):
    rows = [(f"B{i}", f"2025-11-02 {i:02d}:00:00", "70", "40", "5", "3", "OBJ_3", "Котельная", "Тверь") for i in range(n)]
    return spark.createDataFrame(rows, "id string, data string, t_forward string, t_revers string, p_forward string, "
                                       "p_revers string, object_id string, name_koteln string, name_mr string")


def sensor(**change):
    row = dict(record_id="r", object_id="o", ts_measurement=1700000000, t_supply=60.0, t_return=50.0, p_supply=6.0,
               p_return=4.0, ts_recorded=1700000060)
    return tuple({**row, **change}.values())


def sensors(spark, *rows):
    return spark.createDataFrame([sensor(**r) for r in rows], SENSORS)


@pytest.mark.parametrize("header, layout", [
    (["T пр", "T обр"], "A"), (["ID объекта"], "A"), (["t_forward"], "B"), (["p_forward", "T пр"], "B"),
    (["x", "y"], "UNKNOWN")])
def test_layout_by_header(header, layout):
    assert L.detect_layout(header) == layout


def test_layout_a_is_split_into_readings_and_objects(spark):
    readings, meta = L.normalize(layout_a(spark, range(3)))
    assert set(readings.columns) == set(SENSORS.names) and meta.columns == OBJECTS.names
    assert dict(readings.dtypes)["ts_recorded"] == "bigint"
    assert {r["facility_name"] for r in meta.collect()} == {"ЦТП-1"}
    first = readings.where("record_id = 'R0'").first()
    assert (first["t_supply"], first["ts_measurement"], first["ts_recorded"]) == (60.0, 1761955200, 1761955260)


def test_layout_b_has_one_time_and_no_types(spark):
    readings, meta = L.normalize(layout_b(spark, 4))
    assert readings.where("ts_measurement = ts_recorded").count() == 4
    assert meta.where("object_type IS NULL AND facility_type IS NULL AND rso IS NULL").count() == 4


def test_unknown_layout_is_skipped(spark):
    assert L.normalize(spark.range(2).toDF("x")) is None
    assert L.union_sources([spark.range(2).toDF("x")]) is None


@pytest.mark.parametrize("kind, plant, municipality, expected", [
    ("Мытищи г.о.", "МКД", None, ("МКД", None, "Мытищи г.о.")),
    ("ТИ", "МКД", "Химки", ("ТИ", "МКД", "Химки")),
    ("Мытищи г.о.", "ЦТП", None, ("Мытищи г.о.", "ЦТП", None)),
    (None, "МКД", "Химки", (None, "МКД", "Химки"))])
def test_shifted_columns(spark, kind, plant, municipality, expected):
    meta = spark.createDataFrame([("1", kind, plant, "n", municipality, "r")], OBJECTS)
    row = L.repair_shifted(meta).first()
    assert (row["object_type"], row["facility_type"], row["municipality"]) == expected


def test_bad_dates_never_become_zero(spark):
    readings, _ = L.normalize_a(layout_a(spark, [1], **{"Дата и время записи": "мусор"}))
    assert readings.first()["ts_recorded"] is None
    assert C.clean_ingest(readings).count() == 0


def test_arrival_rules(spark):
    df = sensors(spark, dict(record_id="ok"), dict(record_id=None), dict(object_id=None), dict(ts_recorded=None),
                 dict(record_id="zero", ts_recorded=0), dict(record_id="hot", t_supply=200.0, p_return=25.0),
                 dict(record_id="dead", t_supply=None, t_return=-1.0, p_supply=26.0, p_return=None),
                 dict(record_id="late", ts_measurement=None))
    rows = {r["record_id"]: r for r in C.clean_ingest(df).collect()}
    assert set(rows) == {"ok", "zero", "hot", "late"}
    assert rows["hot"]["t_supply"] is None and rows["hot"]["p_return"] == 25.0
    assert rows["late"]["ts_measurement"] == 1700000060


def test_record_dedup_keeps_the_first(spark):
    df = sensors(spark, dict(ts_recorded=5, t_supply=1.0), dict(ts_recorded=3, t_supply=2.0), dict(record_id="x"))
    assert {(r["record_id"], r["ts_recorded"]) for r in C.dedup_records(df).collect()} == {("r", 3), ("x", 1700000060)}


def test_object_dedup_prefers_a_known_type(spark):
    meta = spark.createDataFrame([("1", None, "a", None, None, None), ("1", "ТИ", None, None, None, None),
                                  ("2", None, "b", None, None, None)], OBJECTS)
    assert {(r["object_id"], r["object_type"]) for r in C.dedup_objects(meta).collect()} == {("1", "ТИ"), ("2", None)}


def test_insert_new_and_its_statistics(spark):
    stored = sensors(spark, dict(record_id="a"), dict(record_id="b"))
    batch = sensors(spark, dict(record_id="b"), dict(record_id="c"), dict(record_id="d"))
    fresh = M.insert_new(stored, batch, "record_id")
    assert sorted(r["record_id"] for r in fresh.collect()) == ["c", "d"]
    assert tuple(M.merge_stats(batch, fresh).first()) == (2, 1)


def test_updates_only_touch_given_fields(spark):
    objects = spark.createDataFrame([("1", "t", "f", "n", "m", "r"), ("2", "t", None, None, None, None)], OBJECTS)
    updates = spark.createDataFrame([("1", "new", None), ("9", "x", "y")], "object_id string, rso string, object_type string")
    rows = {r["object_id"]: r for r in M.apply_updates(objects, updates).collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["rso"] == "new" and rows["1"]["object_type"] == "t"


def test_upload_twice_adds_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = ingest_upload(store, [layout_a(spark, range(5)), layout_b(spark, 3), spark.range(1).toDF("x")]).first()
    assert (first["sensors_inserted"], first["sensors_duplicates"], first["objects_upserted"]) == (8, 0, 3)
    again = ingest_upload(store, [layout_a(spark, range(10))]).first()
    assert (again["sensors_inserted"], again["sensors_duplicates"], again["objects_upserted"]) == (5, 5, 0)
    assert store.sensors().count() == 13 and store.objects().count() == 3
    assert ingest_upload(store, [spark.range(1).toDF("x")]).first()["sensors_inserted"] == 0


def test_incidents_keep_integral_close_time(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("i1", "7566", 100, None, "s"), ("i2", "7566", 200, None, "s")], INCIDENTS)
    assert tuple(add_incidents(store, rows).first()) == (2, 0)
    more = spark.createDataFrame([("i2", "7566", 200, 250, "s"), ("i3", "9533", 300, 400, "s")], INCIDENTS)
    assert tuple(add_incidents(store, more).first()) == (1, 1)
    assert dict(store.incidents().dtypes)["close_ts"] == "bigint"
    assert {(r["incident_id"], r["close_ts"]) for r in store.incidents().collect()} == {("i1", None), ("i2", None), ("i3", 400)}


def weather(spark, *rows):
    return spark.createDataFrame([(d, t, t - 1, t + 1, 18 - t, i) for i, (d, t) in enumerate(rows)],
                                 "date string, t_out_mean double, t_out_min double, t_out_max double, "
                                 "heating_degree double, seq int").withColumn("date", F.col("date").cast("date"))


def test_weather_last_write_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.weather().count() == 0
    assert tuple(upsert_weather(store, weather(spark, ("2026-05-01", 5.0), ("2026-05-02", 6.0)), "seq").first()) == (2, 0)
    assert tuple(upsert_weather(store, weather(spark, ("2026-05-02", 7.0), ("2026-05-04", 1.0), ("2026-05-04", 9.0)),
                                "seq").first()) == (1, 1)
    got = {str(r["date"]): r["t_out_mean"] for r in store.weather().collect()}
    assert got == {"2026-05-01": 5.0, "2026-05-02": 7.0, "2026-05-04": 9.0}
    assert [str(r["date"]) for r in M.missing_days(store.weather(), "2026-05-01", "2026-05-04").collect()] == ["2026-05-03"]


def test_update_objects_in_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    T.append_rows(spark.createDataFrame([("1", "t", "f", "n", "m", "r")], OBJECTS), store.path("objects"))
    update_objects(store, spark.createDataFrame([("1", "x")], "object_id string, municipality string"))
    assert store.objects().first()["municipality"] == "x"
    before = store.objects()
    update_objects(store, spark.createDataFrame([("1", "y")], "object_id string, rso string"))
    assert before.first()["rso"] == "r"  # the version read before the update is still there
    T.append_rows(spark.createDataFrame([("2", "t", "f", "n", "m", "r")], OBJECTS), store.current("objects"))
    assert sorted((r["object_id"], r["municipality"], r["rso"]) for r in store.objects().collect()) == [
        ("1", "x", "y"), ("2", "m", "r")]


def test_a_failed_replacement_leaves_the_old_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    upsert_weather(store, weather(spark, ("2026-05-01", 5.0)), "seq")
    broken = store.weather().withColumn("t_out_mean", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        T.replace_table(broken, store.path("weather"))
    assert [r["t_out_mean"] for r in store.weather().collect()] == [5.0]


def test_feature_rules_prune_the_months_of_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "sensors")
    T.append_sensors(sensors(spark, dict(record_id="a", ts_recorded=1700000000), dict(record_id="b", ts_recorded=1764547200)), path)
    kept = C.clean_features(T.read_or_empty(spark, path, SENSORS), 2025)
    assert [r["record_id"] for r in kept.collect()] == ["b"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "event_month" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_appends_are_partitioned_by_month_and_prune(spark, tmp_path):
    path = str(tmp_path / "sensors")
    T.append_sensors(sensors(spark, dict(record_id="a", ts_recorded=1761955200), dict(record_id="b", ts_recorded=1764547200)), path)
    stored = T.read_or_empty(spark, path, SENSORS)
    december = T.between_days(stored, "2025-12-01", "2025-12-31")
    assert [r["record_id"] for r in december.collect()] == ["b"]
    plan = december._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan and "PushedFilters: [IsNotNull(ts_recorded)" in plan


def test_csv_landing_keeps_row_order(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text("id,data,t_forward,t_revers,p_forward,p_revers,object_id\n"
                    "1,2025-01-01 00:00:00,60,,,,o\n1,2025-01-01 00:00:00,61,,,,o\n2,45658.0,x,,1.5,,o\n", encoding="utf-8")
    readings, _ = L.union_sources([L.read_landing(spark, str(path))])
    rows = {r["record_id"]: r for r in readings.collect()}
    assert rows["1"]["t_supply"] == 60.0 and rows["2"]["ts_recorded"] == 1735689600 and rows["2"]["p_supply"] == 1.5


def test_export_covers_the_last_day(spark, tmp_path):
    df = sensors(spark, dict(record_id="a", ts_recorded=1761955200 + 86399), dict(record_id="b", ts_recorded=1761955200 + 86400))
    assert T.write_export(df, str(tmp_path / "out"), "2025-11-01", "2025-11-01") == 1
    assert spark.read.parquet(str(tmp_path / "out")).columns == T.EXPORT_COLUMNS
