"""Cleaning, intraday, calendar and trailing-window features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.series import Windowed, with_windowed
from fieldpulse.operators import features as X
from fieldpulse.operators.cleaning import clean_features, dedup_measurements
from fieldpulse.operators.weather import heating_degree
from fieldpulse.plans import sql_parts as P
from fieldpulse.plans import view_sql as V
from fieldpulse.plans.catalog import query
from fieldpulse.plans.jobs import Store, rebuild_features
from fieldpulse.schemas import FEATURES, SCALE_FLOOR, schema_version
from fieldpulse.session import scratch
from fieldpulse.sources.star_views import StarViews
from fieldpulse.sources.tables import MONTH, append_sensors, export_period, slice_matrix

YEAR, NIGHT = 2024, (0, 6)
KEY = {"object_id": "VARCHAR", "date": "DATE"}
CH = {"t_supply": "d", "t_return": "d", "p_supply": "d", "p_return": "d"}
SPOKEN = ("p_supply_mean", "dp_mean", "dt_mean", "t_supply_mean")


def _readings(v: StarViews) -> DataFrame:
    return dedup_measurements(clean_features(v.sensors(), YEAR))


def _intraday(v: StarViews) -> DataFrame:
    return X.intraday(_readings(v), NIGHT)


def _panel(v: StarViews, values: dict[str, Windowed]) -> DataFrame:
    """Windowed values over the supplier panel."""
    return with_windowed(X.with_day_number(v.panel()), values).select("object_id", "date", *values)


@query("clean_bounds", f"WITH {V.CLEANED} SELECT_FINAL * FROM cleaned",
       object_id="VARCHAR", ts_measurement="BIGINT", ts_recorded="BIGINT", **CH)
def clean_bounds(v):
    return clean_features(v.sensors(), YEAR).drop("record_id")


@query("dedup_measurements", f"WITH {V.DEDUPED} SELECT_FINAL * FROM deduped",
       object_id="VARCHAR", ts_measurement="BIGINT", ts_recorded="BIGINT", **CH)
def dedup(v):
    return _readings(v)


_DAY = [f"{s}_{m}" for s in V.SIGNALS for m in ("mean", "std", "min", "max")]


@query("intraday_daily", f"WITH {V.INTRADAY} SELECT_FINAL * FROM intraday", **KEY, n_samples="BIGINT",
       **{c: "d" for c in [*_DAY, "p_supply_median", "p_supply_skew", "dp_skew"]})
def intraday_daily(v):
    return _intraday(v).select("object_id", "date", "n_samples", *_DAY, "p_supply_median", "p_supply_skew", "dp_skew")


_RATIOS = ["dp_night", "dp_day", "dt_night", "dt_day", "dp_night_ratio", "dt_night_ratio", "p_drop_night",
           "p_supply_range", "p_supply_min_to_mean", "p_supply_drop_depth_intraday", "dp_range"]


@query("night_day_ratios", f"WITH {V.INTRADAY} SELECT_FINAL * FROM intraday", **KEY, **{c: "d" for c in _RATIOS})
def night_day_ratios(v):
    return _intraday(v).select("object_id", "date", *_RATIOS)


_CAL = ["t_out_mean", "sin_month", "cos_month", "sin_weekday", "cos_weekday"]


@query("weather_join_calendar", f"""WITH {V.DAILY} SELECT_FINAL *,
       CASE WHEN t_out_mean IS NOT NULL THEN greatest(0, 18 - t_out_mean) END AS heating_degree FROM daily""",
       **KEY, low_coverage="INTEGER", **{c: "d" for c in [*_CAL, "heating_degree"]})
def weather_join_calendar(v):
    d = X.daily(_intraday(v), v.weather())
    return d.withColumn("heating_degree", heating_degree()).select(
        "object_id", "date", "low_coverage", *_CAL, "heating_degree")


@query("curve_residual", f"""WITH {V.PANEL}, fit AS ({P.residual('dt_mean', 't_supply_mean', 'panel', 'resid')})
       SELECT_FINAL object_id, date, resid FROM fit""", **KEY, resid="d")
def curve_residual(v):
    return _panel(v, {"resid": X.curve_residual("dt_mean", "t_supply_mean")})


@query("robust_z_30d", f"WITH {V.PANEL} SELECT_FINAL object_id, date, "
       + ", ".join(f"{P.robust_z(c, SCALE_FLOOR[c])} AS {c}_z" for c in SPOKEN) + " FROM panel",
       **KEY, **{f"{c}_z": "d" for c in SPOKEN})
def robust_z_30d(v):
    return _panel(v, {f"{c}_z": X.robust_z(c) for c in SPOKEN})


@query("roll_slope_7d", f"WITH {V.PANEL} SELECT_FINAL object_id, date, "
       + ", ".join(f"{P.slope(c, 7)} AS {c}_slope" for c in SPOKEN) + " FROM panel",
       **KEY, **{f"{c}_slope": "d" for c in SPOKEN})
def roll_slope_7d(v):
    return _panel(v, {f"{c}_slope": X.roll_slope(c, 7) for c in SPOKEN})


@query("roll_slope_30d", f"WITH {V.PANEL} SELECT_FINAL object_id, date, "
       + ", ".join(f"{P.slope(c, 30)} AS {c}_slope" for c in SPOKEN) + " FROM panel",
       **KEY, **{f"{c}_slope": "d" for c in SPOKEN})
def roll_slope_30d(v):
    return _panel(v, {f"{c}_slope": X.roll_slope(c, 30) for c in SPOKEN})


@query("accel", f"WITH {V.PANEL} SELECT_FINAL object_id, date, "
       + ", ".join(f"({P.slope(c, 7)}) - ({P.slope(c, 30)}) AS {c}_accel" for c in SPOKEN) + " FROM panel",
       **KEY, **{f"{c}_accel": "d" for c in SPOKEN})
def accel(v):
    return _panel(v, {f"{c}_accel": X.acceleration(c) for c in SPOKEN})


# a spread of exactly zero must count as zero in both engines: prices never repeat exactly, quantities may
@query("vol_ratio", f"""WITH {V.PANEL} SELECT_FINAL object_id, date,
       ({P.std('t_supply_mean', 7)}) / nullif({P.std('t_supply_mean', 30)}, 0) AS ratio FROM panel""", **KEY, ratio="d")
def vol_ratio(v):
    return _panel(v, {"ratio": X.vol_ratio("t_supply_mean")})


_ANOM = f"""zed AS (SELECT *, {P.robust_z('p_supply_mean', SCALE_FLOOR['p_supply_mean'])} AS p_z,
       {P.robust_z('t_supply_mean', SCALE_FLOOR['t_supply_mean'])} AS t_z FROM panel), flagged AS (
       SELECT *, coalesce(abs(p_z) > 1.5, false) OR coalesce(abs(t_z) > 1.5, false) AS anom FROM zed)"""


def _flagged(v: StarViews) -> DataFrame:
    z = with_windowed(X.with_day_number(v.panel()),
                      {"p_z": X.robust_z("p_supply_mean"), "t_z": X.robust_z("t_supply_mean")})
    return z.withColumn("anom", X.anomaly_flag(["p_z", "t_z"], 1.5))


@query("days_since_anomaly", f"""WITH {V.PANEL}, {_ANOM} SELECT_FINAL object_id, date, anom,
       date - max(CASE WHEN anom THEN date END) {P.HIST} AS days_since FROM flagged""",
       **KEY, anom="BOOLEAN", days_since="INTEGER")
def days_since_anomaly(v):
    return with_windowed(_flagged(v), {"days_since": X.days_since("anom")}).select(
        "object_id", "date", "anom", "days_since")


@query("anomaly_freq_14d", f"""WITH {V.PANEL}, {_ANOM} SELECT_FINAL object_id, date,
       CASE WHEN count(*) {P.over(14)} >= 3 THEN avg(CAST(anom AS INTEGER)) {P.over(14)} END AS freq FROM flagged""",
       **KEY, freq="d")
def anomaly_freq_14d(v):
    return with_windowed(_flagged(v), {"freq": X.roll_share("anom", 14)}).select("object_id", "date", "freq")


@query("ewma_cross", f"""WITH {V.PANEL}, fast AS ({P.ewm('dp_mean', 3, 'panel', 'f')}),
       slow AS ({P.ewm('dp_mean', 14, 'panel', 's')})
       SELECT_FINAL p.object_id, p.date, f - s AS crossover FROM panel p JOIN fast USING (object_id, ord)
       JOIN slow USING (object_id, ord)""", **KEY, crossover="d")
def ewma_cross(v):
    return X.ewma_cross(X.with_day_number(v.panel()), "dp_mean", "crossover").select("object_id", "date", "crossover")


_Z = {c: P.robust_z(c, f) for c, f in SCALE_FLOOR.items()}
_MATRIX = f"""{V.DAILY}, c1 AS ({P.residual('t_supply_mean', 't_out_mean', 'daily', 't_supply_vs_curve')}),
  c2 AS ({P.residual('dt_mean', 't_out_mean', 'c1', 'dt_vs_expected')}),
  zed AS (SELECT *, {_Z['p_supply_mean']} AS p_supply_robust_z, {_Z['dp_mean']} AS dp_robust_z,
                 {_Z['t_supply_mean']} AS t_supply_robust_z FROM c2),
  flagged AS (SELECT *, coalesce(abs(p_supply_robust_z) > 3, false) OR coalesce(abs(dp_robust_z) > 3, false) AS anom FROM zed),
  fast AS ({P.ewm('dp_mean', 3, 'daily', 'f')}), slow AS ({P.ewm('dp_mean', 14, 'daily', 's')}),
  matrix AS (SELECT m.*, ({P.slope('p_supply_mean', 7)}) - ({P.slope('p_supply_mean', 30)}) AS p_supply_accel,
    {P.slope('dp_mean', 30)} AS dp_slope_30d, {P.slope('dt_mean', 30)} AS dt_slope_30d,
    ({P.slope('dt_mean', 7)}) - ({P.slope('dt_mean', 30)}) AS dt_accel,
    {P.slope('t_supply_vs_curve', 7)} AS t_supply_vs_curve_slope_7d,
    {P.slope('t_supply_vs_curve', 30)} AS t_supply_vs_curve_slope_30d,
    ({P.std('dp_mean', 7)}) / nullif({P.std('dp_mean', 30)}, 0) AS dp_vol_ratio,
    date - max(CASE WHEN anom THEN date END) {P.HIST} AS days_since_last_anomaly,
    CASE WHEN count(*) {P.over(14)} >= 3 THEN avg(CAST(anom AS INTEGER)) {P.over(14)} END AS dp_exceed_freq_14d,
    f - s AS ewma_cross_dp
    FROM flagged m JOIN fast USING (object_id, ord) JOIN slow USING (object_id, ord))"""


@query("feature_matrix", f"WITH {_MATRIX} SELECT_FINAL * FROM matrix", **KEY, **{c: "d" for c in FEATURES})
def feature_matrix(v):
    return X.build_matrix(v.sensors(), v.weather(), YEAR, NIGHT)


@query("matrix_incremental", f"WITH {_MATRIX} SELECT_FINAL * FROM matrix", **KEY, **{c: "d" for c in FEATURES})
def matrix_incremental(v):
    """The matrix after three builds: some readings of every day, then the rest of the old days, then the new days."""
    store = Store(v.spark, scratch(v.spark, "incremental"))
    v.weather().withColumn("heating_degree", F.lit(None).cast("double")).write.parquet(store.path("weather"))
    late, new = F.col("record_id").cast("long") % 5 == 0, F.col("ts_recorded") >= 1705708800
    for part in (~late & ~new, late & ~new, new):
        append_sensors(v.sensors().where(part), store.path("sensors"))
        rebuild_features(store, YEAR, NIGHT)
    return store.matrix().drop(MONTH)


@query("matrix_slice", f"""WITH {_MATRIX} SELECT_FINAL * FROM matrix
       WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'""", **KEY, **{c: "d" for c in FEATURES})
def matrix_slice(v):
    """Features look at the whole history; the slice only filters the result."""
    return slice_matrix(X.build_matrix(v.sensors(), v.weather(), YEAR, NIGHT), "2024-01-10", "2024-01-20")


@query("rebuild_stats", f"""WITH {V.SENSORS}, {V.WEATHER} SELECT_FINAL
       (SELECT count(*) FROM (SELECT DISTINCT object_id, d FROM (SELECT object_id, {V.DAY} AS d FROM (
          SELECT object_id, ts_measurement, min(ts_recorded) AS ts_recorded FROM sensors GROUP BY 1, 2)))) AS object_days,
       (SELECT count(DISTINCT object_id) FROM sensors) AS objects, (SELECT count(*) FROM sensors) AS sensor_rows,
       (SELECT count(*) FROM weather) AS weather_days, 'e50ab8aa70914bf2' AS schema_version""",
       object_days="BIGINT", objects="BIGINT", sensor_rows="BIGINT", weather_days="BIGINT", schema_version="VARCHAR")
def rebuild_stats(v):
    matrix = X.build_matrix(v.sensors(), v.weather(), YEAR, NIGHT)
    return X.rebuild_stats(matrix, v.sensors(), v.weather(), schema_version())


@query("export_period", f"""WITH {V.SENSORS} SELECT_FINAL * FROM sensors
       WHERE {V.DAY} BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""",
       object_id="VARCHAR", ts_measurement="BIGINT", ts_recorded="BIGINT", **CH)
def export(v):
    return export_period(v.sensors(), "2024-01-05", "2024-01-12")
