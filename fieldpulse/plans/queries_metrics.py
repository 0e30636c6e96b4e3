"""Detection, discrimination, concordance and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.operators import metrics as M
from fieldpulse.operators import resampling as B
from fieldpulse.operators import survival as C
from fieldpulse.plans import view_sql as V
from fieldpulse.plans.catalog import query
from fieldpulse.sources.star_views import StarViews

THR = 0.2

_LABELLED = """labelled AS (SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS y
       FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _auc(source: str) -> str:
    return f"""(SELECT (sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
       / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) FROM (
       SELECT y, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score DESC) * -1 + count(*) OVER () + 1) / 2 AS r
       FROM {source}))"""


def _ap(source: str) -> str:
    return f"""(SELECT sum(p / total * tp / (tp + fp)) FROM (SELECT p, sum(p) OVER () AS total,
       sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM (
       SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM {source} GROUP BY score)))"""


@query("budget_threshold", f"WITH {V.SCORES} SELECT_FINAL quantile_cont(score, 0.98) AS threshold FROM scores", threshold="d")
def budget_threshold(v):
    return M.budget_threshold(v.scores())


@query("class_weight", f"""WITH {V.SCORED}, t AS (SELECT count(*) FILTER (t_to_failure <= 720) AS p, count(*) AS n FROM scored)
       SELECT_FINAL n - p AS negatives, p AS positives, (n - p) / greatest(p, 1) AS weight FROM t""",
       negatives="BIGINT", positives="BIGINT", weight="d")
def class_weight(v):
    return M.class_weight(v.scored_panel())


@query("roc_auc", f"WITH {_LABELLED} SELECT_FINAL {_auc('labelled')} AS roc_auc", roc_auc="d")
def roc_auc(v):
    return M.roc_auc(v.labelled_scores())


@query("avg_precision", f"WITH {_LABELLED} SELECT_FINAL {_ap('labelled')} AS pr_auc", pr_auc="d")
def avg_precision(v):
    return M.average_precision(v.labelled_scores())


@query("discrimination", f"""WITH {V.SCORED}, l AS (SELECT score, CASE WHEN t_to_failure <= 720 THEN 1 ELSE 0 END AS y FROM scored)
       SELECT_FINAL avg(y) AS base_rate, {_auc('l')} AS roc_auc, {_ap('l')} AS pr_auc FROM l""",
       base_rate="d", roc_auc="d", pr_auc="d")
def discrimination(v):
    return M.discrimination(v.scored_panel())


_OBJ = f"""per AS (SELECT object_id, count(*) AS opportunities, bool_or(score >= {THR}) AS detected,
       max(CASE WHEN score >= {THR} THEN t_to_failure END) / 24 AS lead FROM scored
       WHERE t_to_failure > 0 AND t_to_failure <= 1440 GROUP BY 1)"""


@query("object_detection", f"WITH {V.SCORED}, {_OBJ} SELECT_FINAL * FROM per", object_id="VARCHAR",
       opportunities="BIGINT", detected="BOOLEAN", lead="d")
def object_detection(v):
    return M.object_detection(v.scored_panel(), THR)


@query("detection_report", f"""WITH {V.SCORED}, {_OBJ}, b AS (SELECT avg(CAST(score >= {THR} AS INTEGER)) AS share,
         count(*) FILTER (score >= {THR}) / count(DISTINCT date) AS per_day FROM scored),
       r AS (SELECT count(*) AS fail_objects, count(*) FILTER (detected) AS detected,
         avg(CAST(detected AS INTEGER)) AS detection, avg(1 - pow(1 - share, opportunities)) AS detection_null,
         quantile_cont(opportunities, 0.5) AS opp_median, quantile_cont(lead, 0.5) AS lead_median,
         avg(CAST(lead <= 30 AS INTEGER)) AS "lead_within_H", any_value(per_day) AS alerts_per_day FROM per, b)
       SELECT_FINAL *, detection - detection_null AS detection_lift FROM r""",
       fail_objects="BIGINT", detected="BIGINT", detection="d", detection_null="d", detection_lift="d", opp_median="d",
       lead_median="d", lead_within_H="d", alerts_per_day="d")
def detection_report(v):
    return M.detection(v.scored_panel(), THR)


def customers(v: StarViews) -> DataFrame:
    """Customers as objects: how long they kept ordering, whether the last order is finished, balance as score."""
    o = v.table("orders").groupBy(F.col("o_custkey").alias("object_id")).agg(
        F.datediff(F.max(F.col("o_orderdate").cast("date")), F.min(F.col("o_orderdate").cast("date"))).alias("d"),
        F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("l"))
    c = v.table("customer").select(F.col("c_custkey").alias("object_id"), F.round("c_acctbal", -2).alias("score"))
    return o.join(c, "object_id").select(
        "object_id", F.greatest(F.col("d").cast("double"), F.lit(1.0)).alias("duration"),
        (F.col("l.o_orderstatus") == "F").cast("int").alias("event"), "score")


CUSTOMERS = """last AS (SELECT o_custkey, o_orderstatus FROM orders QUALIFY row_number() OVER (
         PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
       objects AS (SELECT o.o_custkey AS object_id,
         greatest(CAST(max(CAST(o.o_orderdate AS DATE)) - min(CAST(o.o_orderdate AS DATE)) AS DOUBLE), 1) AS duration,
         CAST(any_value(l.o_orderstatus) = 'F' AS INTEGER) AS event, round(any_value(c_acctbal) / 100) * 100 AS score
         FROM orders o JOIN customer ON o.o_custkey = c_custkey JOIN last l ON l.o_custkey = o.o_custkey GROUP BY 1)"""


@query("c_index", f"""WITH {CUSTOMERS} SELECT_FINAL sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5
       ELSE 0.0 END) / count(*) AS c_index FROM objects a JOIN objects b
       ON a.event = 1 AND (a.duration < b.duration OR (a.duration = b.duration AND b.event = 0))""", c_index="d")
def c_index(v):
    return C.c_index(customers(v))


@query("cumulative_hazard", f"""WITH {CUSTOMERS}, d AS (SELECT duration, sum(event) AS events, count(*) AS n FROM objects GROUP BY 1),
       r AS (SELECT *, sum(n) OVER (ORDER BY duration DESC) AS at_risk FROM d)
       SELECT_FINAL duration, events, at_risk, sum(events / at_risk) OVER (ORDER BY duration) AS hazard FROM r""",
       duration="d", events="BIGINT", at_risk="BIGINT", hazard="d")
def cumulative_hazard(v):
    return C.cumulative_hazard(customers(v))


@query("permutation_null")
def permutation_null(v):
    return B.permutation_null(v.scored_panel(), THR)


@query("bootstrap_detection")
def bootstrap_detection(v):
    return B.bootstrap_detection(v.scored_panel(), THR)


@query("bootstrap_roc")
def bootstrap_roc(v):
    return B.bootstrap_roc(v.scored_panel())


# Draws have no SQL. What they must agree with has: the exact values stand beside the draws' verdict on them.
@query("permutation_fit", f"""WITH {V.SCORED}, {_OBJ}, b AS (SELECT avg(CAST(score >= {THR} AS INTEGER)) AS share FROM scored)
       SELECT_FINAL avg(CAST(detected AS INTEGER)) AS detection, avg(1 - pow(1 - share, opportunities)) AS chance,
       400 AS "B", true AS mean_is_chance, true AS range_holds_mean, true AS lift_is_difference, true AS p_is_share
       FROM per, b""", detection="d", chance="d", B="INTEGER", mean_is_chance="BOOLEAN", range_holds_mean="BOOLEAN",
       lift_is_difference="BOOLEAN", p_is_share="BOOLEAN")
def permutation_fit(v):
    """The permutation floor beside the chance it estimates: the means differ by less than half the 95 % range."""
    exact = M.detection(v.scored_panel(), THR).select(
        "detection", F.col("detection_null").alias("chance"), F.lit(1).alias("_one"))
    both = exact.join(B.permutation_null(v.scored_panel(), THR).withColumn("_one", F.lit(1)), "_one")
    mean, low, high = (F.col(f"null_{c}") for c in ("mean", "lo", "hi"))
    return both.select(
        "detection", "chance", "B", (F.abs(mean - F.col("chance")) <= (high - low) / 2).alias("mean_is_chance"),
        mean.between(low, high).alias("range_holds_mean"),
        (F.abs(F.col("lift") + mean - F.col("detection")) < 1e-9).alias("lift_is_difference"),
        F.col("p_value").between(0, 1).alias("p_is_share"))


@query("bootstrap_fit", f"""WITH {V.SCORED}, {_OBJ}, l AS (SELECT score,
         CASE WHEN t_to_failure <= 720 THEN 1 ELSE 0 END AS y FROM scored)
       SELECT_FINAL avg(CAST(detected AS INTEGER)) AS detection, {_auc('l')} AS roc_auc,
       true AS detection_inside, true AS width_is_binomial, true AS roc_inside FROM per""",
       detection="d", roc_auc="d", detection_inside="BOOLEAN", width_is_binomial="BOOLEAN", roc_inside="BOOLEAN")
def bootstrap_fit(v):
    """Both bootstrap intervals beside the exact values: they hold them, and the width is the binomial one within a third."""
    panel = v.scored_panel()
    one = F.lit(1).alias("_one")
    exact = M.detection(panel, THR).select("detection", "fail_objects", one)
    area = M.discrimination(panel).select("roc_auc", one)
    both = exact.join(area, "_one").join(B.bootstrap_detection(panel, THR).withColumn("_one", F.lit(1)), "_one").join(
        B.bootstrap_roc(panel).withColumn("_one", F.lit(1)), "_one")
    share, width = F.col("detection"), F.col("detection_hi") - F.col("detection_lo")
    binomial = 2 * 1.96 * F.sqrt(share * (1 - share) / F.col("fail_objects"))
    # a count moves in steps of one object
    slack = binomial / 3 + 2 / F.col("fail_objects")
    return both.select(
        "detection", "roc_auc", share.between(F.col("detection_lo"), F.col("detection_hi")).alias("detection_inside"),
        (F.abs(width - binomial) <= slack).alias("width_is_binomial"),
        F.col("roc_auc").between(F.col("roc_lo"), F.col("roc_hi")).alias("roc_inside"))
