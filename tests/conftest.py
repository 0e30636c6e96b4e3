from __future__ import annotations

import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldpulse.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.maxMetadataStringLength": "4000", "spark.sql.debug.maxToStringFields": "500"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int, start: str = "2026-01-01") -> date:
    return date.fromisoformat(start) + timedelta(days=n)


def scored(spark, rows):
    """(object, day number, score[, ttf]) rows as a scored panel."""
    data = [(r[0], day(r[1]), float(r[2]), float(r[3]) if len(r) > 3 and r[3] is not None else None) for r in rows]
    return spark.createDataFrame(data, "object_id string, date date, score double, t_to_failure double")


def ints(df, column):
    return sorted(r[column] for r in df.collect())
