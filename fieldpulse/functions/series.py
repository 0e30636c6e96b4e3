"""Window helpers for one-row-per-object-and-day tables.

All of them order by an integer day number (``_ord``) inside an object. A partition holds at most one row per calendar
day of one object, so its size is bounded by the length of the history and not by the number of readings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fieldpulse.functions.values import col


def by_object(order: str = "_ord") -> WindowSpec:
    return Window.partitionBy("object_id").orderBy(order)


# frames of one object's rows in day order: everything so far, and the trailing calendar days
HISTORY = "(PARTITION BY object_id ORDER BY _ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def last_days(days: int) -> str:
    """The trailing ``days`` calendar days, the current one included."""
    return f"(PARTITION BY object_id ORDER BY _ord RANGE BETWEEN {days - 1} PRECEDING AND CURRENT ROW)"


def look_back(weight: float, floor: float = 1e-17) -> int:
    """How many observations carry a weight above ``floor`` when each older one counts ``weight`` times less."""
    rows, left = 0, 1.0
    while left > floor:
        left *= weight
        rows += 1
    return rows


@dataclass(frozen=True)
class Windowed:
    """A value in two steps, both SQL: window aggregates under temporary names, then an expression over those names.

    The planner evaluates every occurrence of a window aggregate on its own. Naming each aggregate once and building
    the formula on the names keeps a formula that mentions it five times from computing it five times.
    """

    raw: dict[str, str]
    out: str


def with_windowed(df: DataFrame, values: dict[str, Windowed]) -> DataFrame:
    """Add several windowed values; aggregates they share are computed once."""
    raw = {name: sql for v in values.values() for name, sql in v.raw.items()}
    kept = [f"`{c}`" for c in df.columns if c not in values]
    looked = df.selectExpr("*", *[f"{sql} AS `{name}`" for name, sql in raw.items()])
    return looked.selectExpr(*kept, *[f"{v.out} AS `{name}`" for name, v in values.items()])


def span_decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


@dataclass(frozen=True)
class Ewm:
    """Exponentially weighted mean of ``value`` with the usual ``span`` (decay 1 - 2 / (span + 1) per observation).

    ``adjust=True`` divides by the summed weights, a NULL ages the weights and carries the last mean;
    ``adjust=False`` is the plain recursion started at the first observation.
    """

    value: str
    span: int
    adjust: bool = True

    @property
    def decay(self) -> float:
        return span_decay(self.span)


def with_ewm(df: DataFrame, means: dict[str, Ewm], order: str = "_ord") -> DataFrame:
    """Add exponentially weighted means over each object's observations at a constant cost per row.

    Observations are numbered and cut into blocks long enough for a whole block's weight to vanish in double
    precision. Inside a block the mean is a running sum of values scaled by 1 / decay^position, which cannot overflow
    there; every row also takes part in the following block (if the object has one), so a mean looks back over at
    least one full block. The blocks need no shuffle beyond the one that brings an object's days together.
    """
    block = max(look_back(m.decay) for m in means.values())
    keep = df.columns
    numbered = df.withColumns({"_rn": F.row_number().over(by_object(order)) - 1,
                               "_rows": F.count(F.lit(1)).over(Window.partitionBy("object_id"))})
    own = F.floor(F.col("_rn") / block).cast("int")
    place = F.col("_rn") % block
    here = F.struct(own.alias("block"), place.alias("place"), F.lit(True).alias("own"))
    ahead = F.struct((own + 1).alias("block"), (place - block).alias("place"), F.lit(False).alias("own"))
    copies = F.when((own + 1) * block < F.col("_rows"), F.array(here, ahead)).otherwise(F.array(here))
    spread = numbered.withColumn("_c", F.explode(copies)).select("*", "_c.block", "_c.place", "_c.own")
    so_far = Window.partitionBy("object_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)

    raw, out = {}, {}
    for name, m in means.items():
        scale = F.pow(F.lit(m.decay), -F.col("place"))
        x = F.col(m.value)
        if m.adjust:
            raw[f"_num_{name}"] = F.sum(x * scale).over(so_far)
            raw[f"_den_{name}"] = F.sum(F.when(x.isNotNull(), scale)).over(so_far)
            out[name] = F.try_divide(F.col(f"_num_{name}"), F.col(f"_den_{name}"))
        else:
            share = F.when(F.col("_rn") == 0, F.lit(1.0)).otherwise(F.lit(1.0 - m.decay))
            raw[f"_num_{name}"] = F.sum(x * share * scale).over(so_far)
            out[name] = F.col(f"_num_{name}") * F.pow(F.lit(m.decay), F.col("place"))
    return spread.withColumns(raw).where("own").select(*keep, *[c.alias(name) for name, c in out.items()])


def bias_corrected_skew(value: Column | str) -> Column:
    """Sample skewness G1: undefined below three values, zero for a constant signal."""
    value = col(value)
    n = F.count(value)
    # a constant signal may leave rounding dust in the variance, the extremes do not
    flat = F.min(value) == F.max(value)
    g1 = F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when(n < 3, None).when(flat, F.lit(0.0)).otherwise(g1)
