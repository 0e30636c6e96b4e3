"""Landed tables in two layouts, and the violation journal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.functions.values import clean_string, first_number, parse_moment, to_epoch, to_number
from fieldpulse.operators.cleaning import clean_ingest, dedup_objects, dedup_records
from fieldpulse.schemas import (
    CHANNELS, JOURNAL_COLUMNS, LAYOUT_A, LAYOUT_A_NAME_ALIAS, LAYOUT_B, OBJECTS, SENSORS, SHIFTED_PATTERN, SHIFTED_TYPE,
)

ORIGIN = ["source_file", "source_block", "source_row"]


def detect_layout(columns: list[str]) -> str:
    """'B', 'A' or 'UNKNOWN' from the header; the marks of B are looked for first."""
    have = set(columns)
    if have & {"t_forward", "p_forward"}:
        return "B"
    if have & {"T пр", "ID объекта"}:
        return "A"
    return "UNKNOWN"


def read_landing(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Header-named rows as text, with their origin: file, split and row."""
    if kind == "csv":
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    else:
        raw = spark.read.format(kind).load(path)
        raw = raw.select([F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns])
    # rows of one split keep their order in the low bits of the generated id, splits are ordered by their offset
    return raw.withColumns({"source_file": F.col("_metadata.file_name"),
                            "source_block": F.col("_metadata.file_block_start"),
                            "source_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    missing = [c for c in OBJECTS.names[1:] if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in missing})


def _pair(df: DataFrame, measured: Column) -> tuple[DataFrame, DataFrame]:
    ids = {"object_id": clean_string("object_id"), "record_id": clean_string("record_id")}
    typed = df.withColumns({**ids, "ts_measurement": measured, "ts_recorded": to_epoch("ts_recorded"),
                            **{c: to_number(c) for c in CHANNELS}})
    origin = [c for c in ORIGIN if c in df.columns]
    return typed.select(*SENSORS.names, *origin), typed.select(*OBJECTS.names)


def repair_shifted(meta: DataFrame) -> DataFrame:
    """Undo the column shift of apartment-block rows: the district sits in object_type, the type in facility_type."""
    shifted = F.coalesce((F.trim("facility_type") == SHIFTED_TYPE) & F.col("object_type").rlike(SHIFTED_PATTERN),
                         F.lit(False))
    return meta.withColumns({
        "municipality": F.when(shifted, F.col("object_type")).otherwise(F.col("municipality")),
        "object_type": F.when(shifted, F.lit(SHIFTED_TYPE)).otherwise(F.col("object_type")),
        "facility_type": F.when(~shifted, F.col("facility_type")),
    })


def normalize_a(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layout A to (readings, object rows)."""
    alias, target = LAYOUT_A_NAME_ALIAS
    if alias in df.columns and target not in df.columns:
        df = df.withColumnRenamed(alias, target)
    sensors, meta = _pair(_renamed(df.drop("#"), LAYOUT_A), to_epoch("ts_measurement"))
    return sensors, repair_shifted(meta)


def normalize_b(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layout B to (readings, object rows); it knows one time and no types."""
    df = _renamed(df, LAYOUT_B).withColumns({c: F.lit(None).cast("string") for c in ("object_type", "facility_type")})
    return _pair(df, to_epoch("ts_recorded"))


def normalize(df: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Dispatch on the header; an unknown layout is skipped."""
    layout = detect_layout(df.columns)
    if layout == "A":
        return normalize_a(df)
    return normalize_b(df) if layout == "B" else None


def union_sources(frames: list[DataFrame]) -> tuple[DataFrame, DataFrame] | None:
    """Every recognised source of an upload, cleaned and de-duplicated once over the union."""
    pairs = [p for p in (normalize(f) for f in frames) if p is not None]
    if not pairs:
        return None

    def stack(parts: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    readings = clean_ingest(stack([s for s, _ in pairs]))
    order = [c for c in ORIGIN if c in readings.columns] or ["ts_recorded"]
    sensors = dedup_records(readings, order).select(*SENSORS.names)
    objects = dedup_objects(stack([m for _, m in pairs]).dropna(subset=["object_id"]))
    return sensors, objects


def cast_journal(df: DataFrame, source_file: str | Column) -> DataFrame:
    """The violation journal in its canonical types; rows without a numeric claim id are dropped."""
    missing = [c for c in JOURNAL_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"journal lacks the columns {missing}")
    flags = ("obj_koteln", "obj_ctp", "obj_ts")
    kinds = dict(df.dtypes)

    def flag(c: str) -> Column:
        number = F.col(c).cast("double") if kinds[c] == "boolean" else to_number(c)
        return F.coalesce(number, F.lit(0.0)) != 0

    source = F.lit(source_file) if isinstance(source_file, str) else source_file
    return df.select(
        to_number("id_cds_claim").cast("bigint").alias("id_cds_claim"), "name_mr", "text_message",
        first_number("t_ov").alias("t_ov"),
        *[parse_moment(c).alias(c) for c in ("d_create", "d_doklad", "d_close")],
        *[flag(c).alias(c) for c in flags],
        source.alias("source_file")).dropna(subset=["id_cds_claim"])
