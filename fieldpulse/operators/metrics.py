"""Detection with its random floor, and discrimination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.ranks import quantiles, running_totals
from fieldpulse.operators.target import within_horizon
from fieldpulse.schemas import ALERT_RATE, HORIZON_DAYS, LEAD_CAP_DAYS


def budget_threshold(scored: DataFrame, alert_rate: float = ALERT_RATE) -> DataFrame:
    """One row: the exact (1 - rate) quantile of the scores."""
    return quantiles(scored, "score", [1 - alert_rate]).select(F.get("q", F.lit(0)).alias("threshold"))


def class_weight(panel: DataFrame) -> DataFrame:
    """One row: negatives per positive."""
    return panel.agg(F.count_if(F.col("y") == 0).alias("negatives"), F.count_if(F.col("y") == 1).alias("positives")) \
        .withColumn("weight", F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)))


def object_detection(scored: DataFrame, threshold: float, cap_days: int = LEAD_CAP_DAYS) -> DataFrame:
    """Per failing object: chances to alert, whether any alert came, and the earliest lead in days."""
    inside = scored.where((F.col("t_to_failure") > 0) & (F.col("t_to_failure") <= cap_days * 24))
    fired = F.col("score") >= threshold
    return inside.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("opportunities"), F.bool_or(fired).alias("detected"),
        (F.max(F.when(fired, F.col("t_to_failure"))) / 24).alias("lead"))


def alert_budget(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: rows, alerts and distinct days."""
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score") >= threshold).alias("alerts"),
                      F.count_distinct("date").alias("days"))


def detection(scored: DataFrame, threshold: float, horizon_days: int = HORIZON_DAYS,
              cap_days: int = LEAD_CAP_DAYS) -> DataFrame:
    """Detection rate next to what random alerting with the same budget would detect; one row.

    Both medians see few distinct values: chances are days, leads are whole seconds within the cap.
    """
    objects = object_detection(scored, threshold, cap_days)
    budget = alert_budget(scored, threshold).select(F.struct("rows", "alerts", "days"))
    objects = objects.withColumn("_b", budget.scalar())
    share = F.col("_b.alerts") / F.col("_b.rows")
    missed = F.pow(1.0 - share, F.col("opportunities"))
    out = objects.agg(
        F.count(F.lit(1)).alias("fail_objects"), F.count_if("detected").alias("detected"),
        F.avg(F.col("detected").cast("double")).alias("detection"), F.avg(1.0 - missed).alias("detection_null"),
        F.percentile("opportunities", 0.5).alias("opp_median"), F.percentile("lead", 0.5).alias("lead_median"),
        F.avg((F.col("lead") <= horizon_days).cast("double")).alias("lead_within_H"),
        F.max(F.col("_b.alerts") / F.col("_b.days")).alias("alerts_per_day"))
    return out.withColumn("detection_lift", F.col("detection") - F.col("detection_null"))


def score_table(scored: DataFrame, label: str = "y") -> DataFrame:
    """Distinct scores with their positives and negatives: all that ranking metrics need."""
    return scored.where(F.col("score").isNotNull()).groupBy("score").agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum(1 - F.col(label).cast("bigint")).alias("neg"))


def roc_auc(scored: DataFrame, label: str = "y") -> DataFrame:
    """One row: chance that a positive outranks a negative, ties counting half; NULL with one class only."""
    ranked = running_totals(score_table(scored, label), "score", {"neg_cum": "neg", "pos_cum": "pos"})
    below = F.col("neg_cum") - F.col("neg")
    wins = F.col("pos").cast("double") * (below + F.col("neg") / 2.0)
    return ranked.agg(F.sum(wins).alias("_w"), F.max("pos_cum_total").alias("_p"),
                      F.max("neg_cum_total").alias("_n")).select(
        F.try_divide(F.col("_w"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"))


def average_precision(scored: DataFrame, label: str = "y") -> DataFrame:
    """One row: precision averaged over recall steps, one step per distinct score; NULL with one class only."""
    ranked = running_totals(score_table(scored, label), "score", {"tp": "pos", "fp": "neg"}, descending=True)
    step = F.col("pos") / F.col("tp_total") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    mixed = (F.col("tp_total") > 0) & (F.col("fp_total") > 0)
    return ranked.agg(F.sum(F.when(mixed, step)).alias("pr_auc"))


def discrimination(scored: DataFrame, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """One row: ROC-AUC, average precision and base rate of 'a failure starts within the horizon'."""
    labelled = scored.withColumn("y", within_horizon("t_to_failure", horizon_days))
    return labelled.agg(F.avg(F.col("y").cast("double")).alias("base_rate")).withColumns({
        "roc_auc": roc_auc(labelled).scalar(), "pr_auc": average_precision(labelled).scalar()})
