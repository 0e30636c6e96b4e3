from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import day
from fieldpulse.operators import target as T

INC = "object_id string, incident_ts bigint"


def panel(spark, objects=("A",), days=10, start="2026-01-01"):
    return spark.createDataFrame([(o, day(d, start), float(d)) for o in objects for d in range(days)],
                                 "object_id string, date date, f double")


def seconds(text):
    from datetime import datetime, timezone
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp())


def incidents(spark, *rows):
    return spark.createDataFrame([(o, seconds(t)) for o, t in rows], INC)


def hours(df, object_id="A"):
    return {r["date"]: r["t_to_failure"] for r in df.where(F.col("object_id") == object_id).collect()}


def test_hours_run_from_the_end_of_the_day_to_the_nearest_incident(spark):
    out = T.add_target(panel(spark, ("A", "B"), 30),
                       incidents(spark, ("A", "2026-01-20"), ("A", "2026-01-06"), ("A", "2025-12-01"), ("A", "2026-01-06 05:00:00")))
    h = hours(out)
    assert h[date(2026, 1, 1)] == 96.0 and h[date(2026, 1, 6)] == 0.01 and h[date(2026, 1, 5)] == 0.01
    assert h[date(2026, 1, 7)] == 288.0 and h[date(2026, 1, 21)] is None
    assert set(hours(out, "B").values()) == {None}
    assert out.where("object_id = 'B' AND y = 1").count() == 0


def test_horizon(spark):
    out = T.add_target(panel(spark, days=60), incidents(spark, ("A", "2026-02-20")))
    assert out.where("y <> cast(coalesce(t_to_failure <= 720, false) as int)").count() == 0
    assert 0 < out.where("y = 1").count() < 60


def test_no_incidents_and_null_keys(spark):
    none = spark.createDataFrame([(None, 5), ("A", None)], INC)
    assert T.add_target(panel(spark), none).where("t_to_failure IS NOT NULL OR y = 1").count() == 0


def test_many_incidents_of_one_object_in_one_day(spark):
    many = spark.range(5000).select(F.lit("A").alias("object_id"), (F.lit(seconds("2026-01-04")) + F.col("id")).alias("incident_ts"))
    assert hours(T.add_target(panel(spark, days=3), many))[date(2026, 1, 3)] == 0.01


def test_explicit_split(spark):
    out = T.temporal_split(panel(spark, days=90), "2026-02-01", "2026-03-01")
    got = {r["split"]: (r["date_from"], r["date_to"], r["window"]) for r in T.split_windows(out).collect()}
    assert got["val"] == (date(2026, 2, 1), date(2026, 2, 28), "2026-02-01..2026-02-28")
    assert got["train"][1] == date(2026, 1, 31) and got["test"][0] == date(2026, 3, 1)


@pytest.mark.parametrize("days, expected", [(151, ("2026-04-01", "2026-05-01")), (140, ("2026-03-01", "2026-04-01"))])
def test_default_cutoffs(spark, days, expected):
    row = T.default_cutoffs(panel(spark, days=days)).first()
    assert (str(row["val_start"]), str(row["test_start"])) == expected


def test_inverted_cutoffs(spark):
    with pytest.raises(ValueError):
        T.temporal_split(panel(spark), "2026-03-01", "2026-02-01")
    with pytest.raises(Exception, match="val_start must come before"):
        T.temporal_split(panel(spark, days=60), val_start="2027-01-01").collect()


def test_object_level(spark):
    frame = T.add_target(panel(spark, ("A", "B", "C"), 60), incidents(spark, ("A", "2026-01-21"), ("C", "2026-01-01 10:00:00")))
    out = {r["object_id"]: r for r in T.object_level(frame, ["f"], 30).collect()}
    # the hours are counted from the end of the day, so the event lies one day before the incident
    assert (out["A"]["event"], out["A"]["duration"], out["A"]["f"]) == (1, 19.0, 9.0)
    assert (out["B"]["event"], out["B"]["duration"], out["B"]["f"]) == (0, 59.0, 14.5)
    # failing on its first day leaves that day as the baseline and a duration of one day
    assert (out["C"]["event"], out["C"]["duration"], out["C"]["f"]) == (1, 1.0, 0.0)


def test_close_events_merge_into_the_first(spark):
    days = [day(d) for d in (20, 0, 7, 8, 14, 15, 16, 0)]
    row = spark.createDataFrame([(days,)], "d array<date>").select(T.merge_events(F.col("d"), 7).alias("k")).first()
    assert row["k"] == [day(0), day(8), day(16)]
