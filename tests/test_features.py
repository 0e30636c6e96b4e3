import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldpulse.functions.series import Ewm, with_ewm, with_windowed
from fieldpulse.operators import features as X
from fieldpulse.operators.cleaning import clean_features, dedup_measurements
from fieldpulse.schemas import FEATURES, KEYS, SCALE_FLOOR, schema_version

READ = "object_id string, ts_measurement bigint, ts_recorded bigint, t_supply double, t_return double, p_supply double, p_return double"
T0 = 1767225600  # 2026-01-01


def readings(spark, objects=("A", "B"), days=40, per_day=24, seed=0):
    """Slow waves per object with noise; pressure sags in the small hours."""
    rng, step, rows = np.random.default_rng(seed), 86400 // per_day, []
    for k, o in enumerate(objects):
        for n in range(days * per_day):
            t, wave = T0 + n * step, np.sin(n * step / 400_000 + k)
            sag = 0.75 * (1 <= t % 86400 // 3600 < 3)
            values = (81 + 7 * wave, 52 - 4 * wave, 7.5 + 0.4 * wave - sag, 3.1 + 0.2 * wave)
            rows.append((o, t, t + 30, *(float(v + rng.normal(scale=v / 60)) for v in values)))
    return spark.createDataFrame(rows, READ)


def weather(spark, days=40):
    rows = [(date(2026, 1, 1) + timedelta(days=d), float(4 * np.cos(d / 3) - d % 7)) for d in range(days)]
    return spark.createDataFrame(rows, "date date, t_out_mean double")


def to_pandas(df):
    return df.orderBy(*KEYS).toPandas()


@pytest.fixture(scope="module")
def matrix(spark):
    return to_pandas(X.build_matrix(readings(spark), weather(spark)))


def test_contract(matrix):
    assert list(matrix.columns) == [*KEYS, *FEATURES] and len(FEATURES) == 31
    assert len(matrix) == 80 and not matrix.duplicated(KEYS).any()
    assert len(schema_version()) == 16 and schema_version() != schema_version(FEATURES[::-1])
    assert not np.isinf(matrix[FEATURES].to_numpy(float)).any()


def test_empty_input_keeps_the_contract(spark):
    out = X.build_matrix(spark.createDataFrame([], READ), weather(spark))
    assert out.columns == [*KEYS, *FEATURES] and out.count() == 0


def test_future_does_not_change_the_past(spark, matrix):
    cut = T0 + 30 * 86400
    changed = readings(spark).withColumns({c: F.when(F.col("ts_recorded") >= cut, F.col(c) * 1.7).otherwise(F.col(c))
                                           for c in ("t_supply", "t_return", "p_supply", "p_return")})
    other = to_pandas(X.build_matrix(changed, weather(spark)))
    past = matrix["date"] < date(2026, 1, 31)
    pd.testing.assert_frame_equal(matrix[past], other[past], rtol=1e-9)
    assert not matrix[~past][FEATURES].equals(other[~past][FEATURES])


def test_other_objects_do_not_matter(spark, matrix):
    alone = to_pandas(X.build_matrix(readings(spark).where("object_id = 'A'"), weather(spark)))
    pd.testing.assert_frame_equal(matrix[matrix.object_id == "A"].reset_index(drop=True), alone, rtol=1e-9)


def test_repeated_uploads_do_not_matter(spark, matrix):
    r = readings(spark)
    again = to_pandas(X.build_matrix(r.unionByName(r.withColumn("ts_recorded", F.col("ts_recorded") + 900)), weather(spark)))
    pd.testing.assert_frame_equal(matrix, again, rtol=1e-9)


def test_missing_weather_leaves_physics_empty(spark):
    out = to_pandas(X.build_matrix(readings(spark, ("A",)), weather(spark).limit(0)))
    assert out["dt_vs_expected"].isna().all() and out["t_supply_std"].notna().all()


def test_feature_bounds_and_clock(spark):
    rows = [("A", T0, T0, 0.0, 999.0, 0.05, 4.0), ("A", T0 + 1, 1600000000, 60.0, 50.0, 6.0, 4.0)]
    out = clean_features(spark.createDataFrame(rows, READ)).collect()
    assert len(out) == 1 and (out[0].t_supply, out[0].t_return, out[0].p_supply, out[0].p_return) == (None, None, None, 4.0)


def test_measurement_dedup_averages_known_values(spark):
    rows = [("A", 1, 30, 60.0, None, 6.0, 4.0), ("A", 1, 20, 62.0, None, None, 4.0), ("B", 1, 20, 1.0, 1.0, 1.0, 1.0),
            ("A", 2, 20, 5.0, 5.0, 5.0, 5.0), (None, 2, 20, 5.0, 5.0, 5.0, 5.0)]
    out = {(r.object_id, r.ts_measurement): r for r in dedup_measurements(spark.createDataFrame(rows, READ)).collect()}
    assert set(out) == {("A", 1), ("B", 1), ("A", 2)}
    one = out["A", 1]
    assert (one.t_supply, one.t_return, one.p_supply, one.ts_recorded) == (61.0, None, 6.0, 20)


def test_intraday_against_pandas(spark):
    r = readings(spark, ("A",), days=3, per_day=48).withColumn(
        "p_return", F.when(F.col("ts_recorded") % 7 == 0, None).otherwise(F.col("p_return")))
    out = to_pandas(X.intraday(r))
    pdf = r.toPandas()
    pdf["dp"] = pdf.p_supply - pdf.p_return
    pdf["h"] = pdf.ts_recorded % 86400 // 3600
    g = pdf.groupby(pdf.ts_recorded // 86400)
    assert np.allclose(out.dp_std, g.dp.std()) and np.allclose(out.dp_skew, g.dp.skew())
    assert np.allclose(out.p_supply_median, g.p_supply.median()) and list(out.n_samples) == [48] * 3
    night = pdf[pdf.h == 2].groupby(pdf.ts_recorded // 86400).dp.mean()
    by_day = pdf[(pdf.h >= 10) & (pdf.h < 20)].groupby(pdf.ts_recorded // 86400).dp.mean()
    assert np.allclose(out.dp_night_ratio, night / by_day)
    assert (out.p_drop_night > 0.1).all()


def test_skew_of_few_or_equal_values(spark):
    rows = [("A", T0 + i, T0 + i, 60.0, 50.0, 6.1, 4.0) for i in range(5)] + [("B", T0 + i, T0 + i, 60.0, 50.0, 6.0 + i, 4.0) for i in range(2)]
    out = {r.object_id: r.p_supply_skew for r in X.intraday(spark.createDataFrame(rows, READ)).collect()}
    assert out == {"A": 0.0, "B": None}


def test_calendar_and_coverage(spark):
    days = spark.createDataFrame([("A", date(2026, 1, 5), 5), ("A", date(2026, 7, 12), 6)], "object_id string, date date, n_samples bigint")
    out = X.daily(days, weather(spark)).orderBy("date").collect()
    assert [r.low_coverage for r in out] == [1, 0]
    assert math.isclose(out[0].sin_month, math.sin(2 * math.pi / 12)) and out[0].sin_weekday == 0.0  # a Monday
    assert math.isclose(out[1].cos_weekday, math.cos(2 * math.pi * 6 / 7)) and out[1].t_out_mean is None


@pytest.fixture(scope="module")
def gappy(spark):
    """Two objects with missing days and missing values, longer than the blocks of the weighted means."""
    rng = np.random.default_rng(3)
    rows = []
    for o in "AB":
        for d in range(700):
            if rng.random() < 0.8:
                rows.append((o, date(2024, 1, 1) + timedelta(days=d), None if rng.random() < 0.2 else rng.normal(), rng.normal() * 5))
    return spark.createDataFrame(rows, "object_id string, date date, x double, w double").cache()


def pandas_groups(gappy):
    pdf = gappy.toPandas().sort_values(["object_id", "date"]).reset_index(drop=True)
    pdf["date"] = pd.to_datetime(pdf["date"])
    return pdf, pdf.groupby("object_id")


def same(got, expected):
    assert np.allclose(got.to_numpy(float), np.asarray(expected, float), equal_nan=True, rtol=1e-8, atol=1e-9)


def test_trailing_windows_against_pandas(gappy):
    out = with_windowed(X.with_day_number(gappy), {
        "z": X.robust_z("x", floor=0.1), "b": X.roll_slope("x", 7), "s": X.roll_std("x", 30)}).orderBy("object_id", "date").toPandas()
    pdf, _ = pandas_groups(gappy)

    def roll(days, least):
        return pdf.groupby("object_id").rolling(f"{days}D", on="date", min_periods=least)["x"]

    q = [roll(30, 5).quantile(p).to_numpy() for p in (0.25, 0.5, 0.75)]
    z = np.clip((pdf.x - q[1]) / np.maximum((q[2] - q[0]) / 1.349, 0.1), -10, 10)
    same(out.z, z)
    same(out.s, roll(30, 3).std())
    slopes = []
    for _, g in pdf.groupby("object_id"):
        for t in g.date:
            part = g[(g.date <= t) & (g.date > t - pd.Timedelta(days=7))].dropna(subset=["x"])
            slopes.append(np.polyfit((part.date - t).dt.days, part.x, 1)[0] if len(part) >= 3 else np.nan)
    same(out.b, slopes)


def test_weighted_means_against_pandas(gappy):
    out = with_ewm(X.with_day_number(gappy), {
        "fast": Ewm("x", 3), "slow": Ewm("x", 14), "plain": Ewm("w", 10, adjust=False)}).orderBy("object_id", "date").toPandas()
    pdf, g = pandas_groups(gappy)
    same(out.fast, g.x.transform(lambda s: s.ewm(span=3, min_periods=1).mean()))
    same(out.slow, g.x.transform(lambda s: s.ewm(span=14, min_periods=1).mean()))
    same(out.plain, g.w.transform(lambda s: s.ewm(span=10, adjust=False).mean()))


def test_curve_residual_needs_points_and_past_only(gappy):
    out = with_windowed(X.with_day_number(gappy), {"r": X.curve_residual("x", "w")}).orderBy("object_id", "date").toPandas()
    pdf, _ = pandas_groups(gappy)
    expected = []
    for _, g in pdf.groupby("object_id"):
        for i in range(len(g)):
            part = g.iloc[: i + 1].dropna(subset=["x"])
            if len(part) < 15 or np.isnan(g.x.iloc[i]):
                expected.append(np.nan)
            else:
                b, a = np.polyfit(part.w, part.x, 1)
                expected.append(g.x.iloc[i] - a - b * g.w.iloc[i])
    same(out.r, expected)


def test_anomaly_history(spark):
    flags = [0, 1, 0, 0, 1, 0]
    rows = [("A", date(2026, 1, 1) + timedelta(days=2 * i), bool(f)) for i, f in enumerate(flags)]
    df = X.with_day_number(spark.createDataFrame(rows, "object_id string, date date, f boolean"))
    out = with_windowed(df, {"since": X.days_since("f"), "freq": X.roll_share("f", 14)}).orderBy("date").collect()
    assert [r.since for r in out] == [None, 0, 2, 4, 0, 2]
    assert [r.freq for r in out] == [None, None, pytest.approx(1 / 3), 0.25, 0.4, pytest.approx(2 / 6)]


def test_floors_cover_all_normalised_signals():
    assert set(SCALE_FLOOR) == {"p_supply_mean", "dp_mean", "dt_mean", "dp_night", "t_supply_mean"}


def test_one_shuffle_serves_all_trailing_windows(spark):
    plan = X.build_matrix(readings(spark, days=2), weather(spark, 2))._jdf.queryExecution().executedPlan().toString()
    # de-duplication, roll-up, per-object windows, and the weather's own grouping
    assert plan.count("Exchange hashpartitioning") == 4
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
