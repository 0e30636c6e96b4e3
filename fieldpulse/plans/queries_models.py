"""Models and the end-to-end runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.models import acute, boosting, chronic, lifetime, survival_trees
from fieldpulse.operators import features as X
from fieldpulse.operators import target as T
from fieldpulse.operators.cleaning import clean_features, dedup_measurements
from fieldpulse.plans import view_sql as V
from fieldpulse.plans.catalog import query
from fieldpulse.plans.queries_metrics import CUSTOMERS, customers
from fieldpulse.plans.serve import score_days
from fieldpulse.plans.train import TrainSettings, train_run
from fieldpulse.session import cut_lineage
from fieldpulse.sources.star_views import StarViews

DAILY = ["p_supply_mean", "p_supply_std", "p_supply_max", "dp_mean", "dt_mean", "t_supply_mean", "n_samples"]
VAL, TEST = "2024-01-16", "2024-01-23"


def _frame(v: StarViews) -> DataFrame:
    """Intraday features with target and split, written once: the fits read it repeatedly."""
    days = X.intraday(dedup_measurements(clean_features(v.sensors(), 2024)), (0, 6))
    labelled = T.add_target(days.select("object_id", "date", *DAILY), v.severe_incidents())
    return cut_lineage(T.temporal_split(labelled, VAL, TEST))


def _fit(v: StarViews) -> tuple[DataFrame, object]:
    frame = _frame(v)
    model = acute.train_acute(frame.where("split = 'train'"), frame.where("split = 'val'"), DAILY)
    return frame, model


@query("acute_scores")
def acute_scores(v):
    frame, model = _fit(v)
    calibrator = acute.fit_calibrator(acute.predict_acute(model, frame.where("split = 'val'")))
    return score_days(model, calibrator, frame)


@query("isotonic", """WITH RECURSIVE labelled AS (SELECT CAST(d.n_chars AS DOUBLE) AS score, l.quality AS y
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
       pts AS (SELECT score, sum(y) AS s, count(*) AS w, row_number() OVER (ORDER BY score) AS i FROM labelled GROUP BY score),
       cum AS (SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(w) OVER (ORDER BY i) AS cw FROM pts),
       low AS (SELECT a.i, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m, b.i AS upto FROM cum a JOIN cum b ON b.i >= a.i)
       SELECT_FINAL p.score, max(l.m) AS calibrated FROM pts p JOIN low l ON l.i <= p.i AND l.upto = p.i GROUP BY p.score""",
       score="d", calibrated="d")
def isotonic(v):
    """Max-min formula of the isotonic fit, at every distinct score."""
    scored = v.labelled_scores()
    model = acute.fit_calibrator(scored)
    return acute.calibrate(model, scored.select("score").distinct()).select("score", "calibrated")


@query("chronic_model")
def chronic_model(v):
    objects = cut_lineage(T.object_level(_frame(v), DAILY))
    model = chronic.train_chronic(objects, DAILY)
    return chronic.predict_chronic(model, objects).select("object_id", "chronic_score")


@query("aft_median")
def aft_median(v):
    objects = cut_lineage(T.object_level(_frame(v), DAILY))
    return lifetime.predict_lifetime(lifetime.train_lifetime(objects, DAILY), objects).select(
        "object_id", "aft_median_days")


@query("aft_uncensored", f"""WITH {CUSTOMERS}, x AS (SELECT ln(duration) AS y, score FROM objects),
       f AS (SELECT regr_intercept(y, score) AS intercept, regr_slope(y, score) AS slope FROM x)
       SELECT_FINAL intercept, slope * 1000 AS slope, (SELECT sqrt(avg(pow(y - intercept - slope * score, 2))) FROM x) AS sigma
       FROM f""", intercept="d", slope="d", sigma="d")
def aft_uncensored(v):
    """Without a ridge and with every duration taken for a failure, the fit is least squares on the logarithm."""
    model = lifetime.train_lifetime(customers(v).withColumn("event", F.lit(1)), ["score"], ridge=0.0)
    return v.spark.createDataFrame([(model.intercept, 1000 * model.coefficients[0], model.sigma)],
                                   "intercept double, slope double, sigma double")


_SCORE_CUTS = [0.0, 2000.0, 4000.0, 6000.0, 8000.0]


@query("log_rank_cuts", f"""WITH {CUSTOMERS}, cuts AS (SELECT unnest([0.0, 2000.0, 4000.0, 6000.0, 8000.0]) AS cut),
       d AS (SELECT cut, duration, sum(event) AS deaths, count(*) AS n, count(*) FILTER (score < cut) AS l,
         coalesce(sum(event) FILTER (score < cut), 0) AS left_deaths FROM objects, cuts GROUP BY 1, 2),
       r AS (SELECT *, sum(n) OVER w AS risk, sum(l) OVER w AS left_risk FROM d
         WINDOW w AS (PARTITION BY cut ORDER BY duration DESC))
       SELECT_FINAL cut, pow(sum(left_deaths - deaths * left_risk / risk), 2) / sum(CASE WHEN risk > 1 THEN
         deaths * (left_risk / risk) * (1 - left_risk / risk) * (risk - deaths) / (risk - 1) ELSE 0 END) AS statistic
       FROM r GROUP BY cut""", cut="d", statistic="d")
def log_rank_cuts(v):
    """The statistic that survival trees split by, for cuts of the balance."""
    return survival_trees.log_rank_of_cuts(customers(v), "score", _SCORE_CUTS)


_STEPS = {"n_chars": [500.0, 1000.0, 2000.0, 4000.0], "mixed": [10.0, 30.0, 60.0, 80.0]}


def _split_sql() -> str:
    bins = " ".join(f"WHEN '{f}' THEN " + " + ".join(f"CAST(x >= {c} AS INTEGER)" for c in cuts) for f, cuts in _STEPS.items())
    cuts = ", ".join(f"('{f}', {k}, {c})" for f, steps in _STEPS.items() for k, c in enumerate(steps))
    return f"""WITH labelled AS (SELECT CAST(d.n_chars AS DOUBLE) AS n_chars, l.quality AS y,
         CASE WHEN d.n_chars % 5 > 2 * l.quality THEN CAST(d.n_chars % 70 + 30 * l.quality AS DOUBLE) END AS mixed
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
       long AS (SELECT 'n_chars' AS feature, n_chars AS x, y FROM labelled UNION ALL SELECT 'mixed', mixed, y FROM labelled),
       sums AS (SELECT feature, CASE WHEN x IS NOT NULL THEN CASE feature {bins} END END AS b,
         sum(CASE WHEN y = 1 THEN -1.0 ELSE 0.5 END) AS g, sum(CASE WHEN y = 1 THEN 0.5 ELSE 0.25 END) AS h FROM long GROUP BY 1, 2),
       whole AS (SELECT feature, sum(g) AS g, sum(h) AS h, coalesce(sum(g) FILTER (b IS NULL), 0) AS lost_g,
         coalesce(sum(h) FILTER (b IS NULL), 0) AS lost_h FROM sums GROUP BY 1),
       cuts AS (SELECT * FROM (VALUES {cuts}, ('n_chars', 4, NULL), ('mixed', 4, NULL)) AS c(feature, k, threshold)),
       sides AS (SELECT c.feature, c.k, c.threshold, m.missing_left,
         (SELECT coalesce(sum(s.g), 0) FROM sums s WHERE s.feature = c.feature AND s.b <= c.k) + CASE WHEN missing_left THEN lost_g ELSE 0 END AS gl,
         (SELECT coalesce(sum(s.h), 0) FROM sums s WHERE s.feature = c.feature AND s.b <= c.k) + CASE WHEN missing_left THEN lost_h ELSE 0 END AS hl,
         w.g, w.h FROM cuts c JOIN whole w ON w.feature = c.feature, (VALUES (false), (true)) AS m(missing_left)),
       gains AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM sides
         WHERE hl >= 5 AND h - hl >= 5)
       SELECT_FINAL feature, threshold, missing_left, gain, -gl / (hl + 1) AS left_value, -(g - gl) / (h - hl + 1) AS right_value
       FROM gains WHERE gain > 0.000001 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(gain, 9) DESC, missing_left, k) = 1"""


@query("boost_splits", _split_sql(), feature="VARCHAR", threshold="d", missing_left="BOOLEAN", gain="d", left_value="d",
       right_value="d")
def boost_splits(v):
    """The first split of boosted trees by each of two columns, one with missing values that tell; positives count twice."""
    labelled = v.table("documents").join(v.table("labels"), "doc_id").select(
        F.col("n_chars").cast("double").alias("n_chars"), F.col("quality").alias("y"),
        F.when(F.col("n_chars") % 5 > 2 * F.col("quality"), (F.col("n_chars") % 70 + 30 * F.col("quality")).cast("double")).alias("mixed"))
    return boosting.first_splits(labelled, list(_STEPS), list(_STEPS.values()), weight=2.0)


@query("train_report")
def train_report(v):
    """A whole training run on the full feature matrix, reported as one row."""
    matrix = X.build_matrix(v.sensors(), v.weather(), 2024, (0, 6))
    return train_run(matrix, v.severe_incidents(), TrainSettings(val_start=VAL, test_start=TEST)).report
