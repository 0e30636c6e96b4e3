from pyspark.sql import functions as F

from conftest import day
from fieldpulse.schemas import SENSORS
from fieldpulse.streaming import ingest as S

T0 = 1767225600


def reading(i, t, obj="A", t_supply=60.0):
    return (f"r{i}", obj, t, t_supply, 50.0, 6.0, 4.0, t)


def land(spark, path, rows):
    spark.createDataFrame(rows, SENSORS).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SENSORS).parquet(path)


def test_ingest_appends_each_record_once(spark, tmp_path):
    landing, store = str(tmp_path / "in"), str(tmp_path / "store")
    land(spark, landing, [reading(1, T0), reading(1, T0), reading(2, T0 + 60), reading(3, T0, t_supply=-5.0)])
    S.stream_ingest(stream(spark, landing), store, str(tmp_path / "cp")).awaitTermination()
    # much later: old ids again, long forgotten by the stream's own state
    land(spark, landing, [reading(1, T0 + 40 * 86400), reading(4, T0 + 40 * 86400)])
    S.stream_ingest(stream(spark, landing), store, str(tmp_path / "cp")).awaitTermination()
    rows = {r["record_id"]: r for r in spark.read.parquet(store).collect()}
    assert sorted(rows) == ["r1", "r2", "r3", "r4"] and rows["r3"]["t_supply"] is None


def closed(spark, tmp_path, result):
    S.drain(lambda: S.write_table(result, str(tmp_path / "out"), str(tmp_path / "cp")), 2)
    return spark.read.parquet(str(tmp_path / "out"))


def test_days_are_emitted_when_closed_and_late_rows_dropped(spark, tmp_path):
    landing = str(tmp_path / "in")
    land(spark, landing, [reading(i, T0 + i * 3600, t_supply=float(60 + i)) for i in range(4)] + [reading(9, T0 + 3 * 86400)])
    out = closed(spark, tmp_path, S.stream_daily(stream(spark, landing)))
    assert [(r["date"], r["n_samples"], r["t_supply_mean"]) for r in out.collect()] == [(day(0), 4, 61.5)]
    land(spark, landing, [reading(20, T0 + 50)])  # two days behind the watermark
    again = closed(spark, tmp_path, S.stream_daily(stream(spark, landing)))
    assert again.where(F.col("date") == day(0)).agg(F.sum("n_samples")).first()[0] == 4


def test_orders_close_after_the_cooldown(spark, tmp_path):
    landing = str(tmp_path / "in")
    days = [0, 14, 29, 60, 90]
    land(spark, landing, [reading(d, T0 + d * 86400, t_supply=float(d)) for d in days])
    alerts = stream(spark, landing).select("object_id", F.timestamp_seconds("ts_recorded").alias("event_time"),
                                           F.col("t_supply").alias("score"))
    out = closed(spark, tmp_path, S.stream_orders(alerts, 14))
    got = sorted((r["opened_at"], r["last_alert_at"], r["alerts"], r["peak_score"]) for r in out.collect())
    assert got == [(day(0), day(14), 2, 14.0), (day(29), day(29), 1, 29.0), (day(60), day(60), 1, 60.0)]


def test_coverage_counts_objects(spark, tmp_path):
    landing = str(tmp_path / "in")
    land(spark, landing, [reading(i, T0 + i, obj=f"o{i % 30}") for i in range(90)] + [reading(99, T0 + 3 * 86400)])
    assert [tuple(r) for r in closed(spark, tmp_path, S.stream_coverage(stream(spark, landing))).collect()] == [(day(0), 30)]


def test_ingest_keeps_readings_of_any_age(spark, tmp_path):
    landing, store = str(tmp_path / "in"), str(tmp_path / "store")
    for n, days in enumerate(([40], [0, 1], [41], [0, 2])):
        land(spark, landing, [reading(10 * n + d, T0 + d * 86400) for d in days])
        S.stream_ingest(stream(spark, landing), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["ts_recorded"] for r in spark.read.parquet(store).collect()) == [
        T0 + d * 86400 for d in (0, 0, 1, 2, 40, 41)]


def test_open_days_and_orders_complete_the_roll_ups(spark, tmp_path):
    landing = str(tmp_path / "in")
    land(spark, landing, [reading(d, T0 + d * 86400, obj=o, t_supply=float(d)) for o, days in (
        ("A", [0, 1, 20, 21]), ("B", [20]), ("C", [3])) for d in days])
    stored = spark.read.schema(SENSORS).parquet(landing)
    days = closed(spark, tmp_path / "days", S.stream_daily(stream(spark, landing)))
    whole = S.with_open_days(days, stored, S.stream_daily)
    assert sorted((r["object_id"], r["date"]) for r in whole.collect()) == sorted(
        (r["object_id"], r["date"]) for r in S.stream_daily(stored).collect())
    assert days.count() < whole.count() == 6

    def alerts(rows):
        return rows.select("object_id", F.timestamp_seconds("ts_recorded").alias("event_time"), F.col("t_supply").alias("score"))

    done = closed(spark, tmp_path / "orders", S.stream_orders(alerts(stream(spark, landing)), 3))
    got = S.with_open_orders(done, alerts(stored), 3).collect()
    assert sorted((r["object_id"], r["opened_at"], r["last_alert_at"]) for r in got) == [
        ("A", day(0), day(1)), ("A", day(20), day(21)), ("B", day(20), day(20)), ("C", day(3), day(3))]
    # a store without any closed day
    assert S.with_open_days(days.limit(0), stored, S.stream_daily).count() == 6
