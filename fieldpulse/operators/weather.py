"""Daily weather."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldpulse.functions.values import col
from fieldpulse.schemas import HEATING_BASE


def heating_degree(mean: Column | str = "t_out_mean", base: float = HEATING_BASE) -> Column:
    """Degrees below the heating base, never negative, unknown where the mean is unknown."""
    mean = col(mean)
    return F.when(mean.isNotNull(), F.greatest(F.lit(0.0), F.lit(base) - mean))
