"""Alert rules, inspections and the cost frontier."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.functions.ranks import quantiles
from fieldpulse.functions.series import Ewm, with_ewm
from fieldpulse.schemas import (
    COOLDOWN_DAYS, EWMA_SPANS, HORIZON_DAYS, LEAD_CAP_DAYS, PERSIST_LENGTHS, TARGET_DETECTION, THRESHOLD_GRID,
)


@dataclass(frozen=True)
class Profile:
    """A named way of turning daily scores into alerts."""

    name: str
    kind: str = "baseline"  # baseline | persist | ewma | gate
    n: int | None = None
    span: int | None = None
    chronic_top: str | None = None

    @property
    def score(self) -> str:
        return f"ewma{self.span}" if self.kind == "ewma" else "score"


def default_profiles(gates: list[str]) -> list[Profile]:
    return [Profile("baseline"),
            *[Profile(f"persist{n}", "persist", n=n) for n in PERSIST_LENGTHS],
            *[Profile(f"ewma{s}", "ewma", span=s) for s in EWMA_SPANS],
            *[Profile(f"gate_{g}", "gate", chronic_top=g) for g in gates]]


def ewma_score(scored: DataFrame, span: int, name: str | None = None) -> DataFrame:
    """Score smoothed over the object's observations (not calendar days)."""
    return with_ewm(scored, {name or f"ewma{span}": Ewm("score", span, adjust=False)}, order="date")


def _by_date(*keys: str):
    return Window.partitionBy(*keys, "object_id").orderBy("date")


def observation_number(scored: DataFrame) -> DataFrame:
    return scored.withColumn("_obs", F.row_number().over(_by_date()))


def run_length(fired: DataFrame, *keys: str) -> DataFrame:
    """Length so far of the run of consecutive observations, given only the rows above the threshold.

    Consecutive rows keep the difference between their observation number and their place among the fired rows.
    """
    run = fired.withColumn("_island", F.col("_obs") - F.row_number().over(_by_date(*keys)))
    inside = Window.partitionBy(*keys, "object_id", "_island").orderBy("date")
    return run.withColumn("_run", F.row_number().over(inside)).drop("_island")


def mask(scored: DataFrame, profile: Profile, threshold: float) -> DataFrame:
    """The panel with a boolean ``alert``. Gating by a chronic list happens on orders or through ``gate``."""
    if profile.kind == "ewma":
        smooth = ewma_score(scored, profile.span, "_smooth")
        return smooth.withColumn("alert", F.col("_smooth") >= threshold).drop("_smooth")
    above = scored.withColumn("alert", F.col("score") >= threshold)
    if profile.kind != "persist":
        return above
    numbered = observation_number(above)
    island = F.col("_obs") - F.row_number().over(
        Window.partitionBy("object_id", "alert").orderBy("date"))
    numbered = numbered.withColumn("_island", island)
    place = F.row_number().over(Window.partitionBy("object_id", "alert", "_island").orderBy("date"))
    return numbered.withColumn("_place", place).withColumn(
        "alert", F.col("alert") & (F.col("_place") >= profile.n)).drop("_obs", "_island", "_place")


def persist_mask(scored: DataFrame, threshold: float, n: int) -> DataFrame:
    """Alert from the n-th consecutive observation at or above the threshold on."""
    return mask(scored, Profile(f"persist{n}", "persist", n=n), threshold)


def gate(fired: DataFrame, members: DataFrame) -> DataFrame:
    """Keep rows of listed objects."""
    return fired.join(members.select("object_id"), "object_id", "left_semi")


def new_episode(cooldown_days: int, *keys: str) -> Column:
    """True where a fired row opens a new inspection: the object's first, or more than the cooldown after the last."""
    gap = F.date_diff(F.col("date"), F.lag("date").over(_by_date(*keys)))
    return gap.isNull() | (gap > cooldown_days)


def inspections(fired: DataFrame, cooldown_days: int = COOLDOWN_DAYS) -> DataFrame:
    """One row: number of inspections opened by fired rows."""
    return fired.withColumn("_new", new_episode(cooldown_days)).agg(F.count_if("_new").alias("inspections"))


def _evaluate(fired: DataFrame, totals: DataFrame, keys: list[str], horizon_days: int, cap_days: int,
              cooldown_days: int) -> DataFrame:
    """Budget, detection and cost per rule from the fired rows alone, tagged with ``keys``."""
    ahead = F.when((F.col("t_to_failure") > 0) & (F.col("t_to_failure") <= cap_days * 24), F.col("t_to_failure"))
    opened = fired.withColumn("_new", new_episode(cooldown_days, *keys))
    objects = opened.groupBy(*keys, "object_id").agg(
        F.count(F.lit(1)).alias("_days"), F.count_if("_new").alias("_orders"), (F.max(ahead) / 24).alias("_lead"))
    # leads are whole seconds within the cap, so the median sees a bounded number of distinct values
    rules = objects.groupBy(*keys).agg(
        F.sum("_days").alias("alert_days"), F.sum("_orders").alias("inspections"),
        F.count("_lead").alias("detected"), F.percentile("_lead", 0.5).alias("lead_median"),
        F.avg((F.col("_lead") <= horizon_days).cast("double")).alias("lead_within_H"))
    zero = F.lit(0).cast("bigint")
    return rules.withColumn("fail_objects", totals.scalar()).select(
        *keys, "alert_days", "inspections", F.coalesce("fail_objects", zero).alias("fail_objects"), "detected",
        (F.col("detected") / F.greatest(F.col("fail_objects"), F.lit(1))).alias("detection"),
        "lead_median", "lead_within_H", F.try_divide("inspections", "detected").alias("kappa_star"))


def failing_objects(panel: DataFrame, cap_days: int = LEAD_CAP_DAYS) -> DataFrame:
    """One row: objects with at least one day inside the detection window."""
    inside = (F.col("t_to_failure") > 0) & (F.col("t_to_failure") <= cap_days * 24)
    return panel.where(inside).agg(F.count_distinct("object_id").alias("fail_objects"))


def eval_rule(panel: DataFrame, fired: DataFrame, horizon_days: int = HORIZON_DAYS, cap_days: int = LEAD_CAP_DAYS,
              cooldown_days: int = COOLDOWN_DAYS) -> DataFrame:
    """One rule as one row. ``kappa_star`` is NULL (infinite) when nothing was detected."""
    failing = failing_objects(panel, cap_days)
    out = _evaluate(fired.withColumn("_rule", F.lit(1)), failing, ["_rule"], horizon_days, cap_days, cooldown_days)
    # a rule that never fires has no fired rows; its totals are zeros
    one = failing.withColumn("_rule", F.lit(1)).join(out.drop("fail_objects"), "_rule", "left")
    zero = F.lit(0).cast("bigint")
    return one.select(
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("alert_days", "inspections")], "fail_objects",
        F.coalesce("detected", zero).alias("detected"), F.coalesce("detection", F.lit(0.0)).alias("detection"),
        "lead_median", "lead_within_H", "kappa_star")


def grid_shares(grid: tuple[float, float, int] = THRESHOLD_GRID) -> list[float]:
    low, high, n = grid
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def sweep_input(panel: DataFrame, profiles: list[Profile], gates: dict[str, DataFrame] | None = None) -> DataFrame:
    """The panel with what the profiles look at: observation numbers, smoothed scores, gate membership."""
    base = observation_number(panel.select("object_id", "date", "score", "t_to_failure"))
    spans = sorted({p.span for p in profiles if p.kind == "ewma"})
    if spans:
        base = with_ewm(base, {f"ewma{s}": Ewm("score", s, adjust=False) for s in spans}, order="date")
    for name, members in (gates or {}).items():
        listed = members.select("object_id").distinct().withColumn(f"_in_{name}", F.lit(True))
        base = base.join(listed, "object_id", "left")
    return base


def sweep(base: DataFrame, profiles: list[Profile], grid: tuple[float, float, int] = THRESHOLD_GRID,
          horizon_days: int = HORIZON_DAYS, cap_days: int = LEAD_CAP_DAYS,
          cooldown_days: int = COOLDOWN_DAYS) -> DataFrame:
    """Every profile at every threshold of its grid, in one pass over ``sweep_input``.

    A row meets only the thresholds it reaches. The grid starts at the 90 % quantile, so the expanded table holds
    about 1.3 rows per panel row and profile instead of 25, and inspections and runs are found on fired rows alone.
    The input is read once per score column and once for the sweep: write it or cut its lineage when it is costly.
    """
    scores = sorted({p.score for p in profiles})
    cuts = {name: quantiles(base, name, grid_shares(grid)) for name in scores}
    rows = base.withColumns({f"_cuts_{name}": q.scalar() for name, q in cuts.items()})
    reached = [F.col(name) >= F.get(F.col(f"_cuts_{name}"), F.lit(0)) for name in scores]
    rows = rows.where(reduce(lambda a, b: a | b, reached))

    def met(p: Profile) -> Column:
        tagged = F.transform(F.col(f"_cuts_{p.score}"), lambda t, i: F.struct(
            F.lit(p.name).alias("profile"), i.alias("step"), t.alias("threshold"), F.lit(p.n or 1).alias("need")))
        # equal quantiles of a smoothed score may differ in the last bit after interpolation, never by more
        hits = F.filter(tagged, lambda c: c["threshold"] <= F.col(p.score))
        listed = F.coalesce(F.col(f"_in_{p.chronic_top}"), F.lit(False)) if p.kind == "gate" else F.lit(True)
        return F.when(listed, hits).otherwise(F.slice(hits, 1, 0))

    rules = F.explode(F.flatten(F.array(*[met(p) for p in profiles]))).alias("_c")
    fired = rows.select("object_id", "date", "t_to_failure", "_obs", rules).select(
        "object_id", "date", "t_to_failure", "_obs", "_c.*")
    fired = run_length(fired, "profile", "step").where(F.col("_run") >= F.col("need"))
    failing = failing_objects(base, cap_days)
    out = _evaluate(fired, failing, ["profile", "step"], horizon_days, cap_days, cooldown_days)

    # grid points at which nothing fired still belong to the frontier
    spec = base.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(p.name).alias("profile"), F.lit(p.score).alias("_on")) for p in profiles])).alias("_p")).select(
        "_p.*")
    spec = spec.withColumns({f"_cuts_{name}": q.scalar() for name, q in cuts.items()})
    chosen = F.coalesce(*[F.when(F.col("_on") == name, F.col(f"_cuts_{name}")) for name in scores])
    points = spec.select("profile", F.posexplode(chosen).alias("step", "threshold"))
    zero = F.lit(0).cast("bigint")
    return points.withColumn("fail_objects", failing.scalar()).join(
        out.drop("fail_objects"), ["profile", "step"], "left").select(
        "profile", "step", "threshold",
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("alert_days", "inspections")], "fail_objects",
        F.coalesce("detected", zero).alias("detected"), F.coalesce("detection", F.lit(0.0)).alias("detection"),
        "lead_median", "lead_within_H", "kappa_star")


def kappa_at_detection(frontier: DataFrame, target: float = TARGET_DETECTION) -> DataFrame:
    """Cheapest cost per detected failure among points that detect enough, per profile."""
    return frontier.groupBy("profile").agg(
        F.min(F.when(F.col("detection") >= target, F.col("kappa_star"))).alias("kappa_star"))


def pick_profiles(frontier: DataFrame, target: float = TARGET_DETECTION) -> DataFrame:
    """Best frontier point per profile and the default profile (cheapest; 'baseline' when none qualifies).

    The frontier has a few hundred rows, whatever the size of the panel.
    """
    usable = (F.col("detection") >= target) & F.col("kappa_star").isNotNull()
    point = F.struct("kappa_star", "step", "threshold", "detection", "inspections", "lead_within_H")
    best = frontier.groupBy("profile").agg(F.min(F.when(usable, point)).alias("b"))
    rows = best.select(
        "profile", F.round("b.kappa_star", 2).alias("kappa_star"), F.round("b.threshold", 6).alias("threshold"),
        F.round("b.detection", 4).alias("detection"), F.col("b.inspections").alias("inspections"),
        F.round("b.lead_within_H", 4).alias("lead_within_H"))
    cheapest = rows.where(F.col("kappa_star").isNotNull()).agg(F.min(F.struct("kappa_star", "profile")).alias("m"))
    default = F.coalesce(cheapest.select("m.profile").scalar(), F.lit("baseline"))
    return rows.withColumn("is_default", F.col("profile") == default)
