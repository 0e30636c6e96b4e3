"""Ranks, thresholds, watch lists and object cards over scored days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.functions.ranks import min_rank, quantiles, running_totals, top_share
from fieldpulse.operators.cleaning import pick_row
from fieldpulse.schemas import BASELINE_DAYS, OBJECTS


def rank_in_day(scored: DataFrame) -> DataFrame:
    """Minimum rank of the score inside each day, highest first."""
    return min_rank(scored, "score", "rank", by=["date"])


def object_thresholds(scored: DataFrame) -> DataFrame:
    """Each object's own p75 and p90 (one score per object and day)."""
    q = F.percentile("score", F.array(F.lit(0.75), F.lit(0.9)))
    return scored.groupBy("object_id").agg(q.alias("q")).select(
        "object_id", F.get("q", F.lit(0)).alias("p75"), F.get("q", F.lit(1)).alias("p90"))


def global_thresholds(scored: DataFrame, alert_threshold: float | None = None) -> DataFrame:
    """Exact p50, p75, p90 of all scores as one row."""
    q = quantiles(scored, "score", [0.5, 0.75, 0.9])
    return q.select(*[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p50", "p75", "p90"))],
                    F.lit(alert_threshold).cast("double").alias("alert_threshold"))


def object_baseline(features: DataFrame, columns: list[str], days: int = BASELINE_DAYS) -> DataFrame:
    """Median features over each object's first days."""
    first = F.min("date").over(Window.partitionBy("object_id"))
    early = features.withColumn("_first", first).where(F.col("date") < F.date_add("_first", days))
    return early.groupBy("object_id").agg(*[F.percentile(c, 0.5).alias(c) for c in columns])


def chronic_rank(scores: DataFrame) -> DataFrame:
    """Rank of the chronic score over all objects, highest first."""
    return min_rank(scores.select("object_id", "chronic_score"), "chronic_score", "chronic_rank")


def chronic_top(chronic: DataFrame, fraction: float) -> DataFrame:
    """Exactly max(floor(n * fraction), 1) objects of best rank; ties are cut by the hash of the object id."""
    return top_share(chronic, "chronic_rank", fraction, "object_id", descending=False).select("object_id")


def chronic_top_by_score(scores: DataFrame, fraction: float, value: str = "chronic_score") -> DataFrame:
    """Objects at or above the (1 - fraction) quantile; ties at the cut all belong."""
    cut = quantiles(scores, value, [1 - fraction]).select(F.get("q", F.lit(0)))
    return scores.withColumn("_cut", cut.scalar()).where(F.col(value) >= F.col("_cut")).select("object_id")


def watchlist(chronic: DataFrame, n: int | None = None) -> DataFrame:
    """Objects by chronic rank, all of them or the first n."""
    ordered = chronic.orderBy("chronic_rank", "object_id")
    return ordered if n is None else ordered.limit(n)


def ranking(ranked: DataFrame, date: str | None = None, n: int | None = None) -> DataFrame:
    """Objects of a day by rank, by default the latest day; all of them or the first n."""
    day = F.lit(date).cast("date") if date else ranked.agg(F.max("date").alias("d")).scalar()
    ordered = ranked.withColumn("_day", day).where(F.col("date") == F.col("_day")).drop("_day").orderBy("rank", "object_id")
    return ordered if n is None else ordered.limit(n)


def risk_timeline(scored: DataFrame, object_id: str | None = None, first: str | None = None,
                  last: str | None = None) -> DataFrame:
    """Scored days in a period, of one object or of all."""
    if object_id is not None:
        scored = scored.where(F.col("object_id") == object_id)
    if first is not None:
        scored = scored.where(F.col("date") >= F.lit(first).cast("date"))
    return scored.where(F.col("date") <= F.lit(last).cast("date")) if last is not None else scored


def risk_dates(scored: DataFrame) -> DataFrame:
    return scored.select("date").distinct()


def above_own_p75(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The score where it reaches the object's own p75, else NULL."""
    joined = scored.join(thresholds.select("object_id", "p75"), "object_id", "left")
    return joined.withColumn("above_p75", F.when(F.col("score") >= F.col("p75"), F.col("score")))


def object_cards(ranked: DataFrame, thresholds: DataFrame, chronic: DataFrame, meta: DataFrame,
                 date: str | None = None, alert_threshold: float | None = None) -> DataFrame:
    """A card per object: its scored day (the wanted one, else its latest), thresholds, chronic rank and catalogue."""
    wanted = F.lit(date).cast("date") if date else F.lit(None).cast("date")
    order = [F.coalesce(F.col("date") == wanted, F.lit(False)), "date"]
    latest = pick_row(ranked, ["object_id"], order, last=True)
    return (latest.withColumn("alert_threshold", F.lit(alert_threshold).cast("double"))
            .join(thresholds.select("object_id", "p75", "p90"), "object_id", "left")
            .join(chronic.select("object_id", "chronic_rank"), "object_id", "left")
            .join(meta.select(*OBJECTS.names), "object_id", "left"))


def score_positions(scored: DataFrame) -> DataFrame:
    """Distinct scores with how many rows lie at or above each."""
    counted = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counted, "score", {"at_or_above": "n"}, descending=True)
