"""Roll-ups that late rows correct, and exact coverage that adds up."""

import random

import pandas as pd
from pyspark.sql import functions as F

from conftest import day
from fieldpulse.operators import coverage as G
from fieldpulse.schemas import SENSORS
from fieldpulse.streaming import ingest as S
from fieldpulse.streaming import stateful as R

T0 = 1767225600


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, folder, schema, revise):
    """What the stream has left after all that has landed so far."""
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    S.write_table(revise(stream), f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def reading(i, t, obj="A", p=None):
    return (f"r{i}", obj, t, 60.0 + i % 5, None if i % 3 else 40.0, p, 4.0, t)


def days_of(frame):
    return {(r.object_id, r.date): tuple(None if x is None else round(x, 9) for x in r[2:]) for r in frame.collect()}


def test_late_rows_correct_days_that_the_watermark_has_closed(spark, tmp_path):
    rng, folder, rows = random.Random(1), str(tmp_path), []
    schema = spark.createDataFrame([], SENSORS).schema
    # the last days come first, so that all others are later than the watermark; day 0 is let go and comes back twice
    for n, days in enumerate(([40, 41], [0, 1, 40], [70], [0, 71], [0, 1, 2, 70])):
        batch = [reading(100 * n + k, T0 + d * 86400 + rng.randrange(86400), rng.choice("AB"), rng.choice([None, 5.0 + k]))
                 for k, d in enumerate(days * 3)]
        land(spark, f"{folder}/in", batch, SENSORS)
        rows += batch
        found = run(spark, folder, schema, lambda s: R.day_revisions(s, keep_days=20))
        whole = S.stream_daily(spark.createDataFrame(rows, SENSORS)).select(
            "object_id", "date", *[f"{c}_mean" for c in R.MEANS], "p_supply_min", "p_supply_max", "n_samples")
        assert days_of(R.merged_days(found)) == days_of(whole)
    assert found.agg(F.max("segment")).first()[0] > 0  # some day was let go and started anew


ALERTS = "object_id string, event_time timestamp, score double"


def orders_of(frame):
    return sorted((r.object_id, r.opened_at, r.last_alert_at, r.alerts, r.peak_score) for r in frame.collect())


def test_orders_are_revised_joined_and_closed(spark, tmp_path):
    folder, rows, seen = str(tmp_path), [], []
    schema = spark.createDataFrame([], ALERTS).schema
    for batch in ([("A", 0), ("A", 20), ("B", 30)], [("A", 4), ("A", 22)], [("A", 2), ("A", 2), ("B", 27)], [("B", 90)], [("A", 24)]):
        part = [(o, day(d), float(d)) for o, d in batch]
        spark.createDataFrame(part, "object_id string, d date, score double").select(
            "object_id", F.col("d").cast("timestamp").alias("event_time"), "score").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        rows += part
        found = run(spark, folder, schema, lambda s: R.order_revisions(s, 3))
        alerts = spark.createDataFrame(rows, "object_id string, d date, score double").select(
            "object_id", F.col("d").cast("timestamp").alias("event_time"), "score")
        merged = R.merged_orders(found)
        assert orders_of(merged) == orders_of(S.stream_orders(alerts, 3))
        seen.append({(r.object_id, r.opened_at): r.open for r in merged.collect()})
    assert ("A", day(4)) in seen[1] and ("A", day(4)) not in seen[2]  # a late alert joined it with the order of day 0
    assert seen[0][("B", day(30))] and not seen[0][("A", day(20))] and not seen[3][("B", day(27))] and seen[3][("B", day(90))]
    # written by batch, never read back: every alert day is revised once
    assert found.count() < 25


def test_bitmaps_count_exactly_in_any_order_and_for_any_days(spark, tmp_path):
    rng, folder = random.Random(3), str(tmp_path)
    rows = [reading(i, T0 + rng.randrange(40) * 86400 + i, f"o{rng.randrange(300)}") for i in range(3000)]
    schema = spark.createDataFrame([], SENSORS).schema
    for part in (rows[2000:], rows[:1000], rows[1000:2000], rows[500:700]):
        land(spark, f"{folder}/in", part, SENSORS)
        S.stream_bitmaps(spark.readStream.schema(schema).parquet(f"{folder}/in"), folder, f"{folder}/state").awaitTermination()
    bitmaps = S.stored_bitmaps(spark, folder)
    frame = spark.createDataFrame(rows, SENSORS).withColumn("date", F.date_from_unix_date(F.floor(F.col("ts_recorded") / 86400).cast("int")))

    def exact(*by):
        return sorted(map(tuple, frame.groupBy(*by).agg(F.count_distinct("object_id")).collect()))
    assert sorted(map(tuple, G.count_objects(bitmaps).collect())) == exact("date")
    month = F.trunc("date", "month").alias("month")
    assert sorted(map(tuple, G.count_objects(bitmaps, month).collect())) == exact(month)
    merged = G.merged_bitmaps(bitmaps)
    assert merged.count() < bitmaps.count() and merged.count() == merged.select("date", "bucket").distinct().count()
    assert sorted(map(tuple, G.count_objects(merged).collect())) == exact("date")
    numbers = spark.read.parquet(f"{folder}/numbers")
    assert numbers.count() == numbers.select("number").distinct().count() == numbers.select("object_id").distinct().count()
    assert G.count_objects(bitmaps.limit(0)).count() == 0


class FakeState:
    """A handle and its one value, counting calls."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append(at)


def test_a_batch_reads_and_writes_the_state_of_an_object_once():
    state, sums = FakeState(), R.DaySums(30)
    sums.init(state)
    days = pd.DataFrame({"ts_recorded": [86400 * d for d in range(40)], **{c: 2.0 for c in R.MEANS}})
    for revision in (1, 2):
        state.calls.clear()
        out = pd.concat(sums.handleInputRows(("A",), iter([days, days]), None))
        assert len(out) == 40 and set(out["revision"]) == {revision} and set(out["n_samples"]) == {2 * revision}
        assert state.calls == ["get", *([31 * R.DAY_MS] if revision == 1 else []), "update"]
