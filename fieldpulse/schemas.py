"""Stored tables, the feature contract and the domain constants."""

from __future__ import annotations

import hashlib

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
_DATE, _TS, _B, _I = T.DateType(), T.TimestampType(), T.BooleanType(), T.IntegerType()

SENSORS = _schema(record_id=_S, object_id=_S, ts_measurement=_L, t_supply=_D, t_return=_D,
                  p_supply=_D, p_return=_D, ts_recorded=_L)
OBJECTS = _schema(object_id=_S, object_type=_S, facility_type=_S, facility_name=_S, municipality=_S, rso=_S)
INCIDENTS = _schema(incident_id=_S, object_id=_S, incident_ts=_L, close_ts=_L, source=_S)
WEATHER = _schema(date=_DATE, t_out_mean=_D, t_out_min=_D, t_out_max=_D, heating_degree=_D)
JOURNAL = _schema(id_cds_claim=_L, name_mr=_S, text_message=_S, t_ov=_D, d_create=_TS, d_doklad=_TS, d_close=_TS,
                  obj_koteln=_B, obj_ctp=_B, obj_ts=_B, source_file=_S)
RESOLUTION = _schema(claim_id=_L, object_id=_S, extracted=_S, score=_D, error=_S)

CHANNELS = ["t_supply", "t_return", "p_supply", "p_return"]
SIGNALS = [*CHANNELS, "dp", "dt"]
KEYS = ["object_id", "date"]

# ---- fixed values -------------------------------------------------------------------------------------------------
# Contract: feature names in model order; the version hash covers name, pipeline version and this order.
CONTRACT_NAME = "final_h30"
PIPELINE_VERSION = "1"
FEATURES = [
    "t_supply_std", "t_return_mean", "p_return_max", "dp_std", "p_supply_skew", "dp_skew", "dp_night", "dt_night",
    "n_samples", "dp_night_ratio", "dt_night_ratio", "p_drop_night", "p_supply_drop_depth_intraday",
    "sin_month", "cos_month", "sin_weekday", "cos_weekday", "low_coverage", "dt_vs_expected",
    "p_supply_robust_z", "t_supply_robust_z", "p_supply_accel", "dp_slope_30d", "dt_slope_30d", "dt_accel",
    "t_supply_vs_curve_slope_7d", "t_supply_vs_curve_slope_30d", "dp_vol_ratio", "days_since_last_anomaly",
    "dp_exceed_freq_14d", "ewma_cross_dp",
]

# Plausible ranges on arrival (zero is kept) and for features (zero means the sensor is off).
INGEST_BOUNDS = {"t_supply": (0.0, 150.0), "t_return": (0.0, 150.0), "p_supply": (0.0, 25.0), "p_return": (0.0, 25.0)}
FEATURE_BOUNDS = {"t_supply": (1.0, 150.0), "t_return": (1.0, 150.0), "p_supply": (0.1, 40.0), "p_return": (0.1, 40.0)}
MIN_YEAR = 2025

# Smallest scale used by the robust z, per signal.
SCALE_FLOOR = {
    "p_supply_mean": 0.09227330088615418,
    "dp_mean": 0.06446541547775268,
    "dt_mean": 0.5118538856506348,
    "dp_night": 0.0646605670452118,
    "t_supply_mean": 0.7851322650909425,
}
TREND_SIGNALS = ["p_supply_mean", "dp_mean", "dt_mean", "dp_night", "t_supply_vs_curve"]
VOLATILITY_SIGNALS = ["p_supply_mean", "dp_mean"]
NIGHT_HOURS = (2, 3)
DAY_HOURS = (10, 20)
LOW_COVERAGE_SAMPLES = 6
ANOMALY_Z = 3.0
CURVE_MIN_POINTS = 15
HEATING_BASE = 18.0

HORIZON_DAYS = 30
BASELINE_DAYS = 30
MERGE_GAP_DAYS = 7
LEAD_CAP_DAYS = 60
COOLDOWN_DAYS = 14
ALERT_RATE = 0.02
TARGET_DETECTION = 0.3
CHRONIC_FRACTIONS = {"top30": 0.30, "top50": 0.50}
THRESHOLD_GRID = (0.90, 0.999, 25)
PERSIST_LENGTHS = (3, 5, 7)
EWMA_SPANS = (5, 10)
FUZZY_THRESHOLD = 85
PLANT_TYPE = "ЦТП"
NOT_FOUND = "не найдено"
LABEL_SOURCE = "тех.нарушения"

# Column names of the two landed layouts and of the violation journal.
LAYOUT_A = {
    "ID": "record_id",
    "Дата и время показателей": "ts_measurement",
    "T пр": "t_supply",
    "T обр": "t_return",
    "P пр": "p_supply",
    "P обр": "p_return",
    "Дата и время записи": "ts_recorded",
    "ID объекта": "object_id",
    "Тип объекта": "object_type",
    "Котельная/ЦТП": "facility_type",
    "Наименование котельной": "facility_name",
    "Муниципалитет": "municipality",
    "РСО": "rso",
}
LAYOUT_A_NAME_ALIAS = ("Наименование объекта", "Наименование котельной")
LAYOUT_B = {
    "id": "record_id",
    "data": "ts_recorded",
    "t_forward": "t_supply",
    "t_revers": "t_return",
    "p_forward": "p_supply",
    "p_revers": "p_return",
    "name_koteln": "facility_name",
    "name_mr": "municipality",
}
JOURNAL_COLUMNS = ["id_cds_claim", "name_mr", "text_message", "t_ov", "d_create", "d_doklad", "d_close",
                   "obj_koteln", "obj_ctp", "obj_ts"]
MISSING_WORDS = ["nan", "None", "NaN", ""]
SHIFTED_TYPE = "МКД"
SHIFTED_PATTERN = r"г\.о\."
# ---- end of fixed values ------------------------------------------------------------------------------------------

MATRIX = T.StructType([T.StructField("object_id", _S), T.StructField("date", _DATE),
                       *[T.StructField(name, _D) for name in FEATURES]])


def schema_version(features: list[str] = FEATURES) -> str:
    """Sixteen hex digits that change whenever the contract's columns, order or formulas change."""
    text = "|".join([CONTRACT_NAME, PIPELINE_VERSION, *features])
    return hashlib.sha256(text.encode()).hexdigest()[:16]
