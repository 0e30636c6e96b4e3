"""Reading-level cleaning and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.values import DAY, finite, to_number, within
from fieldpulse.schemas import CHANNELS, FEATURE_BOUNDS, INGEST_BOUNDS, MIN_YEAR
from fieldpulse.sources.tables import MONTH


def pick_row(df: DataFrame, keys: list[str], order: list[Column | str], last: bool = False) -> DataFrame:
    """One row per key: the smallest (or largest) in ``order``, remaining columns break ties.

    An ordinary min/max over a packed row, so copies collapse before the shuffle however many one key has.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *rest)
    best = (F.max if last else F.min)(packed).alias("_row")
    return df.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def dedup_records(df: DataFrame, order: list[Column | str] = ("ts_recorded",)) -> DataFrame:
    """First row of every record id. Pass the landing order (source file, row) where it is known."""
    return pick_row(df, ["record_id"], list(order))


def dedup_objects(meta: DataFrame) -> DataFrame:
    """One row per object, rows with an object type first."""
    return pick_row(meta, ["object_id"], [F.col("object_type").isNull(), "object_type"])


def clean_ingest(df: DataFrame, bounds: dict[str, tuple[float, float]] = INGEST_BOUNDS) -> DataFrame:
    """Arrival rules: keys present, channels numeric and plausible, at least one channel left.

    A missing measurement time is taken from the recording time.
    """
    kept = df.dropna(subset=["record_id", "object_id", "ts_recorded"])
    channels = {c: within(to_number(c), *bounds[c]) for c in CHANNELS}
    cleaned = kept.withColumns(channels).dropna(how="all", subset=CHANNELS)
    return cleaned.withColumn("ts_measurement", F.coalesce("ts_measurement", "ts_recorded"))


def clean_features(df: DataFrame, min_year: int = MIN_YEAR,
                   bounds: dict[str, tuple[float, float]] = FEATURE_BOUNDS) -> DataFrame:
    """Feature rules: drop broken clocks, blank out implausible values (zeros included), keep the row.

    The clock rule compares the stored seconds with a constant, so it reaches the scan; a stored table is also pruned to
    the months from the first year on.
    """
    first_second = F.unix_date(F.make_date(F.lit(min_year), F.lit(1), F.lit(1))).cast("bigint") * DAY
    kept = df.where(F.col("ts_recorded") >= first_second)
    if MONTH in df.columns:
        kept = kept.where(F.col(MONTH) >= f"{min_year:04d}")
    return kept.withColumns({c: within(finite(c), *bounds[c]) for c in bounds if c in df.columns})


def dedup_measurements(df: DataFrame) -> DataFrame:
    """One row per object and measurement time; repeated readings are averaged, the earliest recording time stays.

    Without a measurement time the recording time is the key.
    """
    channels = [c for c in CHANNELS if c in df.columns]
    means = [F.avg(c).alias(c) for c in channels]
    key = "ts_measurement" if "ts_measurement" in df.columns else "ts_recorded"
    if key == "ts_measurement":
        means.append(F.min("ts_recorded").alias("ts_recorded"))
    return df.dropna(subset=["object_id", key]).groupBy("object_id", key).agg(*means)
