"""Targets, splits, alert rules, orders and risk views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.operators import orders as O
from fieldpulse.operators import risk as K
from fieldpulse.operators import rules as A
from fieldpulse.operators import target as T
from fieldpulse.plans import view_sql as V
from fieldpulse.plans.catalog import query
from fieldpulse.schemas import CHRONIC_FRACTIONS
from fieldpulse.session import cut_lineage
from fieldpulse.sources.star_views import StarViews

KEY = {"object_id": "VARCHAR", "date": "DATE"}
SCORE = {**KEY, "score": "d"}
THR, COOLDOWN = 0.2, 3
VAL, TEST = "2024-01-16", "2024-01-23"

_FAIL_DAY = "(DATE '1970-01-01' + CAST(floor((epoch(CAST(date AS TIMESTAMP)) + round(t_to_failure * 3600)) / 86400) AS INTEGER))"


@query("add_target", f"""WITH {V.SCORED} SELECT_FINAL *, CASE WHEN t_to_failure <= 720 THEN 1 ELSE 0 END AS y
       FROM scored""", **SCORE, t_to_failure="d", y="INTEGER")
def add_target(v):
    return v.scored_panel()


@query("temporal_split", f"""WITH {V.SCORES} SELECT_FINAL *, CASE WHEN date < DATE '{VAL}' THEN 'train'
       WHEN date < DATE '{TEST}' THEN 'val' ELSE 'test' END AS split FROM scores""", **SCORE, split="VARCHAR")
def temporal_split(v):
    return T.temporal_split(v.scores(), VAL, TEST)


_CUT = """cut AS (SELECT CASE WHEN day(m) < 28 THEN date_trunc('month', m) - INTERVAL 1 MONTH
       ELSE date_trunc('month', m) END AS t FROM (SELECT max(date) AS m FROM panel))"""


@query("default_cutoffs", f"""WITH {V.PANEL}, {_CUT} SELECT_FINAL t - INTERVAL 1 MONTH AS val_start, t AS test_start
       FROM cut""", val_start="DATE", test_start="DATE")
def default_cutoffs(v):
    return T.default_cutoffs(v.panel())


@query("split_windows", f"""WITH {V.PANEL}, {_CUT}, s AS (SELECT date, CASE WHEN date < t - INTERVAL 1 MONTH THEN 'train'
       WHEN date < t THEN 'val' ELSE 'test' END AS split FROM panel, cut)
       SELECT_FINAL split, min(date) AS date_from, max(date) AS date_to,
       CAST(min(date) AS VARCHAR) || '..' || CAST(max(date) AS VARCHAR) AS "window" FROM s GROUP BY split""",
       split="VARCHAR", date_from="DATE", date_to="DATE", window="VARCHAR")
def split_windows(v):
    return T.split_windows(T.temporal_split(v.panel()))


_OBJECTS = f"""{V.SCORED}, failing AS (SELECT object_id, min({_FAIL_DAY}) AS ev FROM scored
         WHERE t_to_failure IS NOT NULL GROUP BY 1),
       span AS (SELECT s.object_id, min(date) AS entry, max(date) AS fin, any_value(f.ev) AS ev
         FROM scored s LEFT JOIN failing f USING (object_id) GROUP BY 1),
       base AS (SELECT s.object_id, quantile_cont(s.score, 0.5) AS score FROM scored s JOIN span p USING (object_id)
         WHERE s.date = p.entry OR s.date < least(p.entry + 10, coalesce(p.ev, DATE '9999-01-01')) GROUP BY 1),
       objects AS (SELECT p.object_id, b.score, CAST(greatest(coalesce(ev, fin) - entry, 1) AS DOUBLE) AS duration,
         CASE WHEN ev IS NULL THEN 0 ELSE 1 END AS event,
         CASE WHEN entry < DATE '{VAL}' THEN 'train' WHEN entry < DATE '{TEST}' THEN 'val' ELSE 'test' END AS split
         FROM span p JOIN base b USING (object_id))"""


@query("object_level", f"WITH {_OBJECTS} SELECT_FINAL * FROM objects", object_id="VARCHAR", split="VARCHAR",
       duration="d", event="INTEGER", score="d")
def object_level(v):
    return T.object_level(T.temporal_split(v.scored_panel(), VAL, TEST), ["score"], 10)


@query("merge_events", f"""WITH RECURSIVE {V.SCORES}, kept AS (
         SELECT object_id, min(date) AS fail_day FROM scores GROUP BY 1 UNION ALL
         SELECT k.object_id, min(s.date) FROM kept k JOIN scores s ON s.object_id = k.object_id
          AND s.date > k.fail_day + 3 GROUP BY k.object_id, k.fail_day)
       SELECT_FINAL DISTINCT object_id, fail_day FROM kept""", object_id="VARCHAR", fail_day="DATE")
def merge_events(v):
    """Active days kept when more than three days after the last kept one."""
    days = v.scores().groupBy("object_id").agg(F.collect_list("date").alias("days"))
    return days.select("object_id", F.explode(T.merge_events(F.col("days"), 3)).alias("fail_day"))


@query("failure_events", f"""WITH RECURSIVE {V.SCORED}, days AS (SELECT DISTINCT object_id, {_FAIL_DAY} AS d FROM scored
         WHERE t_to_failure IS NOT NULL), kept AS (
         SELECT object_id, min(d) AS fail_day FROM days GROUP BY 1 UNION ALL
         SELECT k.object_id, min(s.d) FROM kept k JOIN days s ON s.object_id = k.object_id
          AND s.d > k.fail_day + 7 GROUP BY k.object_id, k.fail_day)
       SELECT_FINAL DISTINCT object_id, fail_day FROM kept""", object_id="VARCHAR", fail_day="DATE")
def failure_events(v):
    return T.failure_events(v.scored_panel())


@query("rank_in_day", f"""WITH {V.SCORES} SELECT_FINAL *, rank() OVER (PARTITION BY date ORDER BY score DESC) AS rank
       FROM scores""", **SCORE, rank="INTEGER")
def rank_in_day(v):
    return K.rank_in_day(v.scores())


@query("baseline_mask", f"WITH {V.SCORES} SELECT_FINAL *, score >= {THR} AS alert FROM scores", **SCORE, alert="BOOLEAN")
def baseline_mask(v):
    return A.mask(v.scores(), A.Profile("baseline"), THR)


_RUNS = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY date) AS rn FROM scores),
       runs AS (SELECT *, rn - row_number() OVER (PARTITION BY object_id, score >= 0.1 ORDER BY date) AS isl FROM numbered),
       masked AS (SELECT object_id, date, score, score >= 0.1 AND row_number() OVER (
         PARTITION BY object_id, score >= 0.1, isl ORDER BY date) >= 2 AS alert FROM runs)"""


@query("persist_mask", f"WITH {V.SCORES}, {_RUNS} SELECT_FINAL * FROM masked", **SCORE, alert="BOOLEAN")
def persist_mask(v):
    return A.persist_mask(v.scores(), 0.1, 2)


def _recursive_ewm(span: int, source: str) -> str:
    """The unadjusted mean as a weighted sum: the first score counts in full, later ones with 2 / (span + 1)."""
    k, a = 1 - 2 / (span + 1), 2 / (span + 1)
    return f"""smooth{span} AS (SELECT x.object_id, x.date,
         sum(y.score * CASE WHEN y.rn = 1 THEN 1 ELSE {a} END * pow({k}, x.rn - y.rn)) AS ewma{span}
         FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY date) AS rn FROM {source}) x
         JOIN (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY date) AS rn FROM {source}) y
           ON x.object_id = y.object_id AND y.rn <= x.rn GROUP BY x.object_id, x.date)"""


@query("ewma_score", f"""WITH {V.SCORES}, {_recursive_ewm(5, 'scores')}, {_recursive_ewm(10, 'scores')}
       SELECT_FINAL * FROM smooth5 JOIN smooth10 USING (object_id, date)""", **KEY, ewma5="d", ewma10="d")
def ewma_score(v):
    return A.ewma_score(A.ewma_score(v.scores(), 5), 10).drop("score")


_EPISODES = f"""fired AS (SELECT * FROM scores WHERE score >= {THR}), gaps AS (
         SELECT *, CASE WHEN date - lag(date) OVER w > {COOLDOWN} OR lag(date) OVER w IS NULL THEN 1 ELSE 0 END AS opens
         FROM fired WINDOW w AS (PARTITION BY object_id ORDER BY date)), numbered AS (
         SELECT *, sum(opens) OVER (PARTITION BY object_id ORDER BY date) AS ep FROM gaps), orders_ AS (
         SELECT object_id, min(date) AS opened_at, max(date) AS last_alert_at, count(*) AS alert_days,
                max(score) AS peak_score FROM numbered GROUP BY object_id, ep)"""
ORDER = {"object_id": "VARCHAR", "opened_at": "DATE", "last_alert_at": "DATE", "alert_days": "INTEGER", "peak_score": "d"}


@query("episodes", f"WITH {V.SCORES}, {_EPISODES} SELECT_FINAL * FROM orders_", **ORDER)
def episodes(v):
    return O.to_orders(v.scores().where(F.col("score") >= THR), COOLDOWN)


@query("inspections", f"WITH {V.SCORES}, {_EPISODES} SELECT_FINAL count(*) AS inspections FROM orders_", inspections="BIGINT")
def inspections(v):
    return A.inspections(v.scores().where(F.col("score") >= THR), COOLDOWN)


def _chronic(v: StarViews) -> DataFrame:
    """Mean daily score per object stands in for a chronic score."""
    return K.chronic_rank(v.scores().groupBy("object_id").agg(F.avg("score").alias("chronic_score")))


_CHRONIC = """chronic AS (SELECT object_id, chronic_score, rank() OVER (ORDER BY chronic_score DESC) AS chronic_rank
       FROM (SELECT object_id, avg(score) AS chronic_score FROM scores GROUP BY 1)), top30 AS (SELECT object_id FROM (
       SELECT *, row_number() OVER (ORDER BY chronic_rank, md5(object_id)) AS n, count(*) OVER () AS total FROM chronic)
       WHERE n <= greatest(floor(total * 0.3), 1))"""


@query("chronic_rank", f"WITH {V.SCORES}, {_CHRONIC} SELECT_FINAL * FROM chronic", object_id="VARCHAR",
       chronic_score="d", chronic_rank="INTEGER")
def chronic_rank(v):
    return _chronic(v)


@query("top_fraction", f"WITH {V.SCORES}, {_CHRONIC} SELECT_FINAL * FROM top30", object_id="VARCHAR")
def top_fraction(v):
    return K.chronic_top(_chronic(v), 0.3)


@query("top_fraction_quantile", f"""WITH {V.SCORES}, {_CHRONIC} SELECT_FINAL object_id FROM chronic
       WHERE chronic_score >= (SELECT quantile_cont(chronic_score, 0.7) FROM chronic)""", object_id="VARCHAR")
def top_fraction_quantile(v):
    return K.chronic_top_by_score(_chronic(v), 0.3)


@query("watchlist", f"""WITH {V.SCORES}, {_CHRONIC} SELECT_FINAL * FROM chronic ORDER BY chronic_rank, object_id LIMIT 50""",
       object_id="VARCHAR", chronic_score="d", chronic_rank="INTEGER")
def watchlist(v):
    return K.watchlist(_chronic(v), 50)


@query("gate_orders", f"""WITH {V.SCORES}, {_EPISODES}, {_CHRONIC} SELECT_FINAL o.* FROM orders_ o
       WHERE object_id IN (SELECT object_id FROM top30)""", **ORDER)
def gate_orders(v):
    members = K.chronic_top(_chronic(v), 0.3)
    return O.order_queue(v.scores(), A.Profile("gate_top30", "gate", chronic_top="top30"), THR, members=members,
                         cooldown_days=COOLDOWN)


@query("order_queue", f"""WITH {V.SCORES}, {_EPISODES}, {_CHRONIC} SELECT_FINAL o.*, c.chronic_rank FROM orders_ o
       LEFT JOIN chronic c USING (object_id) WHERE opened_at <= DATE '2024-01-20'
       AND last_alert_at >= DATE '2024-01-20' - {COOLDOWN} ORDER BY peak_score DESC, object_id, opened_at LIMIT 100""",
       **ORDER, chronic_rank="INTEGER")
def order_queue(v):
    orders = O.order_queue(v.scores(), A.Profile("baseline"), THR, "2024-01-20", cooldown_days=COOLDOWN)
    return O.head(O.with_chronic_rank(orders, _chronic(v)), 100)


@query("persist_orders", f"""WITH {V.SCORES}, {_RUNS}, gaps AS (
         SELECT *, CASE WHEN date - lag(date) OVER w > {COOLDOWN} OR lag(date) OVER w IS NULL THEN 1 ELSE 0 END AS opens
         FROM masked WHERE alert WINDOW w AS (PARTITION BY object_id ORDER BY date)), eps AS (
         SELECT *, sum(opens) OVER (PARTITION BY object_id ORDER BY date) AS ep FROM gaps)
       SELECT_FINAL object_id, min(date) AS opened_at, max(date) AS last_alert_at, count(*) AS alert_days,
              max(score) AS peak_score FROM eps GROUP BY object_id, ep""", **ORDER)
def persist_orders(v):
    return O.order_queue(v.scores(), A.Profile("persist2", "persist", n=2), 0.1, cooldown_days=COOLDOWN)


_RULE = {"alert_days": "BIGINT", "inspections": "BIGINT", "fail_objects": "BIGINT", "detected": "BIGINT",
         "detection": "d", "lead_median": "d", "lead_within_H": "d", "kappa_star": "d"}


def _evaluated(keys: str, fired: str) -> str:
    """Rule totals per key list from a table of fired rows."""
    k = f"{keys}, " if keys else ""
    return f"""opened AS (SELECT *, CASE WHEN date - lag(date) OVER w > {COOLDOWN} OR lag(date) OVER w IS NULL THEN 1 ELSE 0
         END AS opens FROM {fired} WINDOW w AS (PARTITION BY {k}object_id ORDER BY date)), per AS (
         SELECT {k}object_id, count(*) AS days, sum(opens) AS n_orders,
           max(CASE WHEN t_to_failure > 0 AND t_to_failure <= 1440 THEN t_to_failure END) / 24 AS lead
         FROM opened GROUP BY {k}object_id), failing AS (SELECT count(DISTINCT object_id) AS f FROM scored
         WHERE t_to_failure > 0 AND t_to_failure <= 1440), rules AS (
         SELECT {k}sum(days) AS alert_days, sum(n_orders) AS inspections, any_value(f) AS fail_objects,
           count(lead) AS detected, count(lead) / greatest(any_value(f), 1) AS detection,
           quantile_cont(lead, 0.5) AS lead_median, avg(CAST(lead <= 30 AS INTEGER)) AS "lead_within_H",
           sum(n_orders) / nullif(count(lead), 0) AS kappa_star FROM per, failing {'GROUP BY ' + keys if keys else ''})"""


@query("eval_rule", f"""WITH {V.SCORED}, fired AS (SELECT * FROM scored WHERE score >= {THR}), {_evaluated('', 'fired')}
       SELECT_FINAL * FROM rules""", **_RULE)
def eval_rule(v):
    panel = v.scored_panel()
    return A.eval_rule(panel, panel.where(F.col("score") >= THR), cooldown_days=COOLDOWN)


GRID = (0.90, 0.999, 25)
PROFILES = A.default_profiles(list(CHRONIC_FRACTIONS))
_SHARES = ", ".join(f"CAST('{q!r}' AS DOUBLE)" for q in A.grid_shares(GRID))
_SWEEP = f"""{V.SCORED}, {_CHRONIC}, {_recursive_ewm(5, 'scores')}, {_recursive_ewm(10, 'scores')},
       top50 AS (SELECT object_id FROM (
         SELECT *, row_number() OVER (ORDER BY chronic_rank, md5(object_id)) AS n, count(*) OVER () AS total FROM chronic)
         WHERE n <= greatest(floor(total * 0.5), 1)),
       base AS (SELECT s.*, e.ewma5, f.ewma10, row_number() OVER (PARTITION BY s.object_id ORDER BY s.date) AS obs
         FROM scored s JOIN smooth5 e USING (object_id, date) JOIN smooth10 f USING (object_id, date)),
       steps AS (SELECT unnest(generate_series(0, 24)) AS step),
       grid AS (SELECT step, a[step + 1] AS raw, b[step + 1] AS smooth5, c[step + 1] AS smooth10 FROM steps, (
         SELECT quantile_cont(score, [{_SHARES}]) AS a, quantile_cont(ewma5, [{_SHARES}]) AS b,
           quantile_cont(ewma10, [{_SHARES}]) AS c FROM base)),
       profiles(profile, need) AS (VALUES ('baseline', 1), ('persist3', 3), ('persist5', 5), ('persist7', 7), ('ewma5', 1),
         ('ewma10', 1), ('gate_top30', 1), ('gate_top50', 1)),
       points AS (SELECT profile, need, step, CASE profile WHEN 'ewma5' THEN smooth5 WHEN 'ewma10' THEN smooth10 ELSE raw
         END AS threshold FROM profiles, grid),
       above AS (SELECT p.profile, p.need, p.step, b.* FROM base b JOIN points p
         ON CASE p.profile WHEN 'ewma5' THEN b.ewma5 WHEN 'ewma10' THEN b.ewma10 ELSE b.score END >= p.threshold
         WHERE (p.profile <> 'gate_top30' OR b.object_id IN (SELECT object_id FROM top30))
           AND (p.profile <> 'gate_top50' OR b.object_id IN (SELECT object_id FROM top50))),
       isl AS (SELECT *, obs - row_number() OVER (PARTITION BY profile, step, object_id ORDER BY date) AS island FROM above),
       fired AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile, step, object_id, island ORDER BY date)
         AS run FROM isl) WHERE run >= need),
       {_evaluated('profile, step', 'fired')},
       frontier AS (SELECT p.profile, p.step, p.threshold, coalesce(alert_days, 0) AS alert_days,
         coalesce(inspections, 0) AS inspections, (SELECT f FROM failing) AS fail_objects,
         coalesce(detected, 0) AS detected, coalesce(detection, 0) AS detection, lead_median, "lead_within_H", kappa_star
         FROM points p LEFT JOIN rules r ON p.profile = r.profile AND p.step = r.step)"""


def _frontier(v: StarViews) -> DataFrame:
    gates = {name: K.chronic_top(_chronic(v), share) for name, share in CHRONIC_FRACTIONS.items()}
    base = cut_lineage(A.sweep_input(v.scored_panel(), PROFILES, gates))
    return A.sweep(base, PROFILES, GRID, cooldown_days=COOLDOWN)


@query("threshold_sweep", f"WITH {_SWEEP} SELECT_FINAL * FROM frontier", profile="VARCHAR", step="INTEGER",
       threshold="d", **_RULE)
def threshold_sweep(v):
    return _frontier(v)


@query("kappa_frontier", f"""WITH {_SWEEP} SELECT_FINAL profile,
       min(CASE WHEN detection >= 0.3 THEN kappa_star END) AS kappa_star FROM frontier GROUP BY profile""",
       profile="VARCHAR", kappa_star="d")
def kappa_frontier(v):
    return A.kappa_at_detection(_frontier(v), 0.3)


@query("pick_profiles", f"""WITH {_SWEEP}, usable AS (SELECT * FROM frontier WHERE detection >= 0.2 AND kappa_star IS NOT NULL),
       best AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY profile ORDER BY kappa_star, step) = 1),
       shown AS (SELECT p.profile, round(kappa_star + 1e-9, 2) AS kappa_star, round(threshold + 1e-9, 6) AS threshold,
         round(detection + 1e-9, 4) AS detection, inspections, round("lead_within_H" + 1e-9, 4) AS "lead_within_H"
         FROM (SELECT DISTINCT profile FROM points) p LEFT JOIN best b USING (profile))
       SELECT_FINAL *, profile = coalesce((SELECT profile FROM shown WHERE kappa_star IS NOT NULL
         ORDER BY kappa_star, profile LIMIT 1), 'baseline') AS is_default FROM shown""",
       profile="VARCHAR", kappa_star="d", threshold="d", detection="d", inspections="BIGINT", lead_within_H="d",
       is_default="BOOLEAN")
def pick_profiles(v):
    return A.pick_profiles(_frontier(v), 0.2)


@query("object_thresholds", f"""WITH {V.SCORES} SELECT_FINAL object_id, quantile_cont(score, 0.75) AS p75,
       quantile_cont(score, 0.9) AS p90 FROM scores GROUP BY 1""", object_id="VARCHAR", p75="d", p90="d")
def object_thresholds(v):
    return K.object_thresholds(v.scores())


@query("global_thresholds", f"""WITH {V.SCORES} SELECT_FINAL quantile_cont(score, 0.5) AS p50,
       quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.9) AS p90, {THR} AS alert_threshold FROM scores""",
       p50="d", p75="d", p90="d", alert_threshold="d")
def global_thresholds(v):
    return K.global_thresholds(v.scores(), THR)


@query("object_baseline", f"""WITH {V.PANEL}, f AS (SELECT *, min(date) OVER (PARTITION BY object_id) AS first FROM panel)
       SELECT_FINAL object_id, quantile_cont(p_supply_mean, 0.5) AS p_supply_mean, quantile_cont(dp_mean, 0.5) AS dp_mean,
       quantile_cont(t_supply_mean, 0.5) AS t_supply_mean FROM f WHERE date < first + 30 GROUP BY 1""",
       object_id="VARCHAR", p_supply_mean="d", dp_mean="d", t_supply_mean="d")
def object_baseline(v):
    return K.object_baseline(v.panel(), ["p_supply_mean", "dp_mean", "t_supply_mean"])


@query("daily_ranking", f"""WITH {V.SCORES} SELECT_FINAL *, rank() OVER (ORDER BY score DESC) AS rank FROM scores
       WHERE date = (SELECT max(date) FROM scores) ORDER BY rank, object_id LIMIT 50""", **SCORE, rank="INTEGER")
def daily_ranking(v):
    return K.ranking(K.rank_in_day(v.scores()), n=50)


@query("risk_timeline", f"""WITH {V.SCORES} SELECT_FINAL * FROM scores WHERE object_id = '7'
       AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""", **SCORE)
def risk_timeline(v):
    return K.risk_timeline(v.scores(), "7", "2024-01-05", "2024-01-25")


@query("risk_dates", f"WITH {V.SCORES} SELECT_FINAL DISTINCT date FROM scores", date="DATE")
def risk_dates(v):
    return K.risk_dates(v.scores())


@query("above_own_p75", f"""WITH {V.SCORES}, t AS (SELECT object_id, quantile_cont(score, 0.75) AS p75 FROM scores GROUP BY 1)
       SELECT_FINAL s.object_id, date, score, CASE WHEN score >= p75 THEN score END AS above_p75
       FROM scores s JOIN t USING (object_id)""", **SCORE, above_p75="d")
def above_own_p75(v):
    return K.above_own_p75(v.scores(), K.object_thresholds(v.scores())).drop("p75")


_CARD = {**SCORE, "rank": "INTEGER", "alert_threshold": "d", "p75": "d", "p90": "d", "chronic_rank": "INTEGER",
         "object_type": "VARCHAR", "facility_type": "VARCHAR", "facility_name": "VARCHAR", "municipality": "VARCHAR",
         "rso": "VARCHAR"}


@query("object_cards", f"""WITH {V.SCORES}, {_CHRONIC}, {V.META}, ranked AS (
         SELECT *, rank() OVER (PARTITION BY date ORDER BY score DESC) AS rank FROM scores),
       t AS (SELECT object_id, quantile_cont(score, 0.75) AS p75, quantile_cont(score, 0.9) AS p90 FROM scores GROUP BY 1),
       latest AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY object_id
         ORDER BY date = DATE '2024-01-20' DESC, date DESC) = 1)
       SELECT_FINAL l.*, {THR} AS alert_threshold, p75, p90, c.chronic_rank, m.object_type, m.facility_type,
         m.facility_name, m.municipality, m.rso FROM latest l LEFT JOIN t USING (object_id)
         LEFT JOIN chronic c USING (object_id) LEFT JOIN meta m USING (object_id)""", **_CARD)
def object_cards(v):
    scores = v.scores()
    return K.object_cards(K.rank_in_day(scores), K.object_thresholds(scores), _chronic(v), v.objects_meta(),
                          "2024-01-20", THR)
