"""The causal object-day feature matrix."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.series import HISTORY, Ewm, Windowed, bias_corrected_skew, last_days, with_ewm, with_windowed
from fieldpulse.functions.values import epoch_date, epoch_hour
from fieldpulse.operators.cleaning import clean_features, dedup_measurements
from fieldpulse.schemas import (
    ANOMALY_Z, CURVE_MIN_POINTS, DAY_HOURS, FEATURES, KEYS, LOW_COVERAGE_SAMPLES, MIN_YEAR, NIGHT_HOURS, SCALE_FLOOR,
    SIGNALS, TREND_SIGNALS, VOLATILITY_SIGNALS,
)


def _base(name: str) -> str:
    return name.replace("_mean", "")


def intraday(df: DataFrame, night: tuple[int, int] = NIGHT_HOURS, day: tuple[int, int] = DAY_HOURS) -> DataFrame:
    """Readings rolled up to one row per object and recording day.

    A single grouped aggregate: moments, extremes and counts combine before the shuffle, and the shuffle key is
    (object, day), so an object with very many readings spreads over its days.
    """
    at_night, by_day = (f"_hour >= {low} AND _hour < {high}" for low, high in (night, day))
    readings = df.select(
        F.col("object_id").cast("string").alias("object_id"),
        epoch_date("ts_recorded").alias("date"),
        epoch_hour("ts_recorded").alias("_hour"),
        "t_supply", "t_return", "p_supply", "p_return",
        (F.col("p_supply") - F.col("p_return")).alias("dp"),
        (F.col("t_supply") - F.col("t_return")).alias("dt"))

    moments = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    measures = [F.expr(f"{f}({s})").alias(f"{s}_{m}") for s in SIGNALS for m, f in moments.items()]
    measures += [F.expr("percentile(p_supply, 0.5D)").alias("p_supply_median"),
                 bias_corrected_skew("p_supply").alias("p_supply_skew"),
                 bias_corrected_skew("dp").alias("dp_skew")]
    for short, signal in (("dp", "dp"), ("dt", "dt"), ("ps", "p_supply")):
        measures += [F.expr(f"avg(CASE WHEN {when} THEN {signal} END)").alias(f"{short}_{part}")
                     for part, when in (("night", at_night), ("day", by_day))]
    measures.append(F.expr("count(*)").alias("n_samples"))

    days = readings.groupBy("object_id", "date").agg(*measures)
    return days.withColumns({
        "dp_night_ratio": F.try_divide("dp_night", "dp_day"),
        "dt_night_ratio": F.try_divide("dt_night", "dt_day"),
        "p_drop_night": F.col("ps_day") - F.col("ps_night"),
        "p_supply_range": F.col("p_supply_max") - F.col("p_supply_min"),
        "p_supply_min_to_mean": F.try_divide("p_supply_min", "p_supply_mean"),
        "p_supply_drop_depth_intraday": F.col("p_supply_median") - F.col("p_supply_min"),
        "dp_range": F.col("dp_max") - F.col("dp_min"),
    }).drop("ps_night", "ps_day")


def daily(days: DataFrame, weather: DataFrame, low: int = LOW_COVERAGE_SAMPLES) -> DataFrame:
    """Attach outdoor temperature and the cyclic calendar.

    The weather side is reduced to one row per calendar day first, which bounds what is broadcast by the number of
    days in the history.
    """
    per_day = weather.groupBy("date").agg(F.max("t_out_mean").alias("t_out_mean"))
    month = F.month("date") * (2 * math.pi / 12)
    weekday = F.weekday("date") * (2 * math.pi / 7)
    return days.join(F.broadcast(per_day), "date", "left").withColumns({
        "sin_month": F.sin(month), "cos_month": F.cos(month),
        "sin_weekday": F.sin(weekday), "cos_weekday": F.cos(weekday),
        "low_coverage": (F.col("n_samples") < low).cast("int"),
    })


def with_day_number(df: DataFrame) -> DataFrame:
    return df.withColumn("_ord", F.unix_date("date"))


def curve_residual(y: str, x: str = "t_out_mean", min_points: int = CURVE_MIN_POINTS) -> Windowed:
    """Distance from the line y = a + b x fitted to the object's rows up to and including this one."""
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    n, slope, start, spread = (f"_{part}_{y}_{x}" for part in ("n", "slope", "start", "spread"))
    raw = {n: f"regr_count({y}, {x}) OVER {HISTORY}", slope: f"regr_slope({y}, {x}) OVER {HISTORY}",
           start: f"regr_intercept({y}, {x}) OVER {HISTORY}", spread: f"regr_sxx({y}, {x}) OVER {HISTORY}"}
    return Windowed(raw, f"CASE WHEN {both} AND {n} >= {min_points} AND {n} * {spread} >= 1e-9D "
                         f"THEN {y} - ({start} + {slope} * {x}) END")


def _counted(value: str, days: int) -> dict[str, str]:
    return {f"_n{days}_{value}": f"count({value}) OVER {last_days(days)}"}


def _gated(value: str, days: int, name: str, aggregate: str, least: int) -> Windowed:
    """A trailing aggregate, defined from ``least`` known values on."""
    name = f"_{name}{days}_{value}"
    return Windowed({**_counted(value, days), name: f"{aggregate} OVER {last_days(days)}"},
                    f"CASE WHEN _n{days}_{value} >= {least} THEN {name} END")


def robust_z(value: str, floor: float | None = None, days: int = 30, min_points: int = 5,
             limit: float = 10.0) -> Windowed:
    """Distance from the trailing median in units of the trailing quartile range, clipped."""
    floor = SCALE_FLOOR[value] if floor is None else floor
    q = f"_q{days}_{value}"
    raw = {**_counted(value, days), q: f"percentile({value}, array(0.25D, 0.5D, 0.75D)) OVER {last_days(days)}"}
    z = f"({value} - {q}[1]) / greatest(({q}[2] - {q}[0]) / 1.349D, {floor!r}D)"
    return Windowed(raw, f"CASE WHEN _n{days}_{value} >= {min_points} AND {value} IS NOT NULL "
                         f"THEN least(greatest({z}, {-limit!r}D), {limit!r}D) END")


def roll_slope(value: str, days: int, min_points: int = 3) -> Windowed:
    """Least-squares slope per day over the trailing calendar days."""
    return _gated(value, days, "b", f"regr_slope({value}, CAST(_ord AS DOUBLE))", min_points)


def roll_std(value: str, days: int, min_points: int = 3) -> Windowed:
    return _gated(value, days, "d", f"stddev_samp({value})", min_points)


def vol_ratio(value: str) -> Windowed:
    """Spread of the last week relative to the last month."""
    week, month = roll_std(value, 7), roll_std(value, 30)
    return Windowed({**week.raw, **month.raw}, f"try_divide({week.out}, {month.out})")


def acceleration(value: str) -> Windowed:
    """Weekly slope minus monthly slope."""
    week, month = roll_slope(value, 7), roll_slope(value, 30)
    return Windowed({**week.raw, **month.raw}, f"({week.out}) - ({month.out})")


def anomaly_flag(scores: list[str], limit: float = ANOMALY_Z) -> Column:
    return F.expr(" OR ".join(f"coalesce(abs({s}) > {limit!r}D, false)" for s in scores))


def days_since(flag: str) -> Windowed:
    """Days since the last flagged day, 0 on the day itself, NULL before the first."""
    latest = f"last(CASE WHEN {flag} THEN date END, true) OVER {HISTORY}"
    return Windowed({f"_last_{flag}": latest}, f"date_diff(date, _last_{flag})")


def roll_share(flag: str, days: int, min_points: int = 3) -> Windowed:
    """Share of flagged rows among the rows of the trailing calendar days."""
    return _gated(flag, days, "m", f"avg(CAST({flag} AS DOUBLE))", min_points)


def carried(value: str) -> Windowed:
    """The value, or the last known one where it is missing."""
    return Windowed({f"_carry_{value}": f"last({value}, true) OVER {HISTORY}"}, f"_carry_{value}")


def ewma_cross(df: DataFrame, value: str, name: str, fast: int = 3, slow: int = 14) -> DataFrame:
    """Fast minus slow exponentially weighted mean."""
    both = with_ewm(df, {"_fast": Ewm(value, fast), "_slow": Ewm(value, slow)})
    return both.withColumn(name, F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")


def interday(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Trends, robust deviations, volatility and history, all from days up to and including the current one.

    Every window shares one partitioning and one order, so the whole stage costs a single exchange and sort.
    ``wanted`` restricts the added columns; by default all of them are built.
    """
    keep = df.columns
    first = {
        "t_supply_vs_curve": curve_residual("t_supply_mean"),
        "dt_vs_expected": curve_residual("dt_mean"),
        **{f"{_base(c)}_robust_z": robust_z(c) for c in SCALE_FLOOR},
    }
    second = {}
    for c in TREND_SIGNALS:
        second[f"{_base(c)}_slope_7d"] = roll_slope(c, 7)
        second[f"{_base(c)}_slope_30d"] = roll_slope(c, 30)
        second[f"{_base(c)}_accel"] = acceleration(c)
    second |= {f"{_base(c)}_vol_ratio": vol_ratio(c) for c in VOLATILITY_SIGNALS}
    second |= {"days_since_last_anomaly": days_since("_anom"), "dp_exceed_freq_14d": roll_share("_anom", 14),
               # a gap longer than the look-back keeps the last known crossover
               "ewma_cross_dp": carried("_cross")}
    added = [c for c in [*first, *second] if wanted is None or c in wanted]
    needed = {*added, "t_supply_vs_curve", "p_supply_robust_z", "dp_robust_z"}

    df = ewma_cross(with_day_number(df), "dp_mean", "_cross")
    df = with_windowed(df, {c: w for c, w in first.items() if c in needed})
    df = df.withColumn("_anom", anomaly_flag(["p_supply_robust_z", "dp_robust_z"]))
    df = with_windowed(df, {c: w for c, w in second.items() if c in needed})
    return df.select(*keep, *added)


def select_contract(df: DataFrame) -> DataFrame:
    """Keys and the contract's features in order; what could not be computed is NULL, nothing is infinite."""
    have = set(df.columns)

    def feature(name: str) -> str:
        value = f"CAST(`{name}` AS DOUBLE)" if name in have else "CAST(NULL AS DOUBLE)"
        return f"CASE WHEN isnan({value}) OR abs({value}) = double('infinity') THEN NULL ELSE {value} END AS `{name}`"

    return df.selectExpr(*KEYS, *[feature(f) for f in FEATURES])


def build_days(sensors: DataFrame, min_year: int = MIN_YEAR, night: tuple[int, int] = NIGHT_HOURS,
               day: tuple[int, int] = DAY_HOURS) -> DataFrame:
    """Stored readings to one row per object and day."""
    return intraday(dedup_measurements(clean_features(sensors, min_year)), night, day)


def matrix_of_days(days: DataFrame, weather: DataFrame) -> DataFrame:
    """Rows per object and day and daily weather to the feature matrix."""
    return select_contract(interday(daily(days, weather), FEATURES))


def build_matrix(sensors: DataFrame, weather: DataFrame, min_year: int = MIN_YEAR,
                 night: tuple[int, int] = NIGHT_HOURS, day: tuple[int, int] = DAY_HOURS) -> DataFrame:
    """Stored readings and daily weather to the feature matrix."""
    return matrix_of_days(build_days(sensors, min_year, night, day), weather)


def rebuild_stats(matrix: DataFrame, sensors: DataFrame, weather: DataFrame, version: str) -> DataFrame:
    """One row of totals for a rebuild."""
    rows = sensors.agg(F.count(F.lit(1)).alias("n"))
    days = weather.agg(F.count(F.lit(1)).alias("n"))
    return matrix.agg(
        F.count(F.lit(1)).alias("object_days"), F.count_distinct("object_id").alias("objects"),
    ).withColumns({"sensor_rows": rows.scalar(), "weather_days": days.scalar(), "schema_version": F.lit(version)})
