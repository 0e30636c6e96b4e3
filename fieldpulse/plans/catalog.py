"""Named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fieldpulse.sources.star_views import StarViews

QUERIES: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[StarViews], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return rounded(self.build(StarViews(spark, folder)))


# Both engines add the same tiny offset before rounding: a decimal tie then falls to the same side.
_OFFSET = 1.3e-10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    def one(c: str) -> str:
        r = f"round(`{c}` + {_OFFSET!r}D, {digits})"
        return f"CASE WHEN {r} = 0 THEN 0.0D ELSE {r} END AS `{c}`"

    return df.selectExpr(*[one(f.name) if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
                           for f in df.schema.fields])


def sql_rounded(columns: dict[str, str], body: str, digits: int = 6) -> str:
    """Wrap a query: columns marked 'd' are rounded doubles, others get the given SQL type."""
    out = []
    for name, kind in columns.items():
        if kind == "d":
            r = f'round(CAST("{name}" AS DOUBLE) + {_OFFSET}, {digits})'
            out.append(f'CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS "{name}"')
        else:
            out.append(f'CAST("{name}" AS {kind}) AS "{name}"')
    head, tail = "", body
    if body.lstrip().upper().startswith("WITH"):
        cut = body.rindex("SELECT_FINAL")
        head, tail = body[:cut], "SELECT" + body[cut + len("SELECT_FINAL"):]
    return f"{head}SELECT {', '.join(out)} FROM ({tail}) AS q"


def query(name: str, sql: str | None = None, /, **columns: str):
    """Register a query. ``columns`` are the result's columns with 'd' for rounded doubles or an SQL type."""
    def register(build: Callable[[StarViews], DataFrame]):
        QUERIES[name] = Query(name, build, sql_rounded(columns, sql) if sql else None)
        return build
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: q.sql for name, q in QUERIES.items() if q.sql}


def _load() -> None:
    from fieldpulse.plans import (  # noqa: F401  registering is their import effect
        queries_alerts, queries_features, queries_ingest, queries_labels, queries_metrics, queries_models,
        queries_store, queries_streams,
    )
