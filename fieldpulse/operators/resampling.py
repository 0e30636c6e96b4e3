"""Permutation floor and bootstrap intervals.

None of them copies the panel once per replicate. The permutation needs only how many failing objects have how many
chances; the detection bootstrap only two counts; the ROC bootstrap one pass over score buckets, with object weights made from
a hash. Other draws come from generators seeded by (seed, replicate, slice), so lost tasks repeat exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.functions.ranks import parts_for, with_bucket
from fieldpulse.operators.metrics import alert_budget, object_detection
from fieldpulse.operators.target import within_horizon
from fieldpulse.schemas import HORIZON_DAYS, LEAD_CAP_DAYS

SLICE_OBJECTS = 20000
CHUNK = 50  # replicates whose weights travel together
BUCKET_ROWS = 200_000  # rows of one score bucket, which one task holds with the weights of a chunk


def _interval(draws: DataFrame, value: str, low: str, high: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.agg(q.alias("q")).select(F.get("q", F.lit(0)).alias(low), F.get("q", F.lit(1)).alias(high))


def permutation_draws(scored: DataFrame, threshold: float, replicates: int = 400, seed: int = 0,
                      cap_days: int = LEAD_CAP_DAYS) -> DataFrame:
    """(replicate, hit): failing objects caught when the same number of alerts falls on random rows.

    Rows are exchangeable, so a replicate only has to split the alerts over groups of objects with equally many
    chances (drawn without replacement) and, inside a group, over its rows. Groups are cut into slices of a bounded
    number of objects, and every (replicate, slice) is its own row of work.
    """
    groups = object_detection(scored, threshold, cap_days).groupBy("opportunities").agg(F.count(F.lit(1)).alias("n"))
    # one row per slice: (chances per object, objects); the last slice of a group takes the rest
    slices = groups.select("opportunities", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("n") - 1) / SLICE_OBJECTS))).alias("i"), "n").select(
        "opportunities", F.least(F.lit(SLICE_OBJECTS), F.col("n") - F.col("i") * SLICE_OBJECTS).alias("objects"), "i")
    # as long as the number of slices: objects / 20000 plus one per distinct number of chances
    plan = slices.agg(F.array_sort(F.collect_list(F.struct("opportunities", "i", "objects"))))
    budget = alert_budget(scored, threshold).select(F.struct("rows", "alerts"))
    spark = scored.sparkSession
    runs = spark.range(0, replicates, 1, min(replicates, spark.sparkContext.defaultParallelism)) \
        .withColumnRenamed("id", "replicate").withColumns({"plan": plan.scalar(), "budget": budget.scalar()})

    def split_alerts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for run, plan_row, budget_row in zip(part["replicate"], part["plan"], part["budget"]):
                chances = np.array([p["opportunities"] for p in plan_row], dtype=np.int64)
                objects = np.array([p["objects"] for p in plan_row], dtype=np.int64)
                left_rows, left_alerts = int(budget_row["rows"]), int(budget_row["alerts"])
                draw = np.random.default_rng([seed, int(run)])
                share = np.zeros(len(chances), dtype=np.int64)
                for i, rows in enumerate(chances * objects):
                    share[i] = _hypergeometric(draw, int(rows), left_rows - int(rows), left_alerts)
                    left_rows -= int(rows)
                    left_alerts -= int(share[i])
                yield pd.DataFrame({"replicate": run, "slice": np.arange(len(chances)), "chances": chances,
                                    "objects": objects, "alerts": share})

    def place_alerts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            hits = [_objects_hit(np.random.default_rng([seed, int(r), int(s), 1]), int(c), int(n), int(a))
                    for r, s, c, n, a in part.itertuples(index=False)]
            yield pd.DataFrame({"replicate": part["replicate"], "hit": hits})

    split = runs.mapInPandas(split_alerts, "replicate bigint, slice bigint, chances bigint, objects bigint, alerts bigint")
    spread = split.repartition("replicate", "slice")
    return spread.mapInPandas(place_alerts, "replicate bigint, hit bigint").groupBy("replicate").agg(
        F.sum("hit").alias("hit"))


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones among ``sample`` taken without replacement, exact for any number of rows.

    Taking every row by its own coin gives binomial counts. Given how many were taken, every choice of them is equally
    likely; rows taken too many or too few (about the root of the sample) are then removed or added one by one.
    """
    total = good + bad
    if 2 * sample > total:
        return good - _hypergeometric(draw, good, bad, total - sample)
    taken, other = (int(draw.binomial(n, sample / total)) if n and sample else 0 for n in (good, bad))
    surplus = taken + other - sample
    if surplus > 0:
        return taken - int((draw.choice(taken + other, surplus, replace=False, shuffle=False) < taken).sum())
    if surplus < 0:
        left = good - taken
        return taken + int((draw.choice(total - taken - other, -surplus, replace=False, shuffle=False) < left).sum())
    return taken


def _objects_hit(draw: np.random.Generator, chances: int, objects: int, alerts: int) -> int:
    """Objects with at least one alert when ``alerts`` of their ``chances * objects`` rows are chosen."""
    if alerts == 0:
        return 0
    rows = draw.choice(chances * objects, alerts, replace=False, shuffle=False)
    return int(np.unique(rows // chances).size)


def permutation_null(scored: DataFrame, threshold: float, replicates: int = 400, seed: int = 0,
                     cap_days: int = LEAD_CAP_DAYS) -> DataFrame:
    """One row: mean and 95 % range of random detection, lift over it and the share of draws at least as good."""
    objects = object_detection(scored, threshold, cap_days)
    real = objects.agg(F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("d")).select(F.struct("n", "d"))
    draws = permutation_draws(scored, threshold, replicates, seed, cap_days).withColumn("_r", real.scalar())
    draws = draws.withColumn("rate", F.col("hit") / F.col("_r.n"))
    q = F.percentile("rate", F.array(F.lit(0.025), F.lit(0.975)))
    out = draws.agg(F.avg("rate").alias("null_mean"), q.alias("q"), F.max(F.col("_r.d") / F.col("_r.n")).alias("real"),
                    F.avg((F.col("hit") >= F.col("_r.d")).cast("double")).alias("p_value"),
                    F.count(F.lit(1)).cast("int").alias("B"))
    return out.select("null_mean", F.get("q", F.lit(0)).alias("null_lo"), F.get("q", F.lit(1)).alias("null_hi"),
                      (F.col("real") - F.col("null_mean")).alias("lift"), "p_value", "B")


def bootstrap_detection(scored: DataFrame, threshold: float, replicates: int = 500, seed: int = 0,
                        cap_days: int = LEAD_CAP_DAYS) -> DataFrame:
    """95 % interval of the detection rate when failing objects are resampled.

    Drawing n objects with replacement, of which d in n are detected, gives a binomial count.
    """
    objects = object_detection(scored, threshold, cap_days)
    counts = objects.agg(F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("d")).select(F.struct("n", "d"))
    runs = scored.sparkSession.range(replicates).withColumnRenamed("id", "replicate").withColumn("c", counts.scalar())

    def resample(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rates = []
            for run, c in zip(part["replicate"], part["c"]):
                n, d = int(c["n"]), int(c["d"])
                draw = np.random.default_rng([seed, int(run)])
                rates.append(float(draw.binomial(n, d / n)) / n if n else None)
            yield pd.DataFrame({"rate": pd.Series(rates, dtype="float64")})

    return _interval(runs.mapInPandas(resample, "rate double"), "rate", "detection_lo", "detection_hi")


def object_weights(scored: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(object_id, chunk, weights): how often an object is drawn in each replicate of a chunk of ``CHUNK`` replicates.

    Every replicate draws as many objects as there are, with replacement. Objects fall into slices by hash; a
    replicate first spreads its draws over the slices (their sizes are all that travels), then every slice spreads
    what it got over its own objects.
    """
    objects = scored.select("object_id").distinct()
    total = objects.agg(F.count(F.lit(1))).scalar()
    sliced = objects.withColumn("_n", total).withColumn("slice", F.pmod(
        F.xxhash64("object_id", F.lit(seed)), F.floor(F.col("_n") / SLICE_OBJECTS) + 1)).drop("_n")
    sizes = sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("slice", "n"))))
    spark = scored.sparkSession
    runs = spark.range(0, replicates, 1, min(replicates, spark.sparkContext.defaultParallelism)) \
        .withColumnRenamed("id", "replicate").withColumn("sizes", sizes.scalar())

    def split_draws(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for run, slices in zip(part["replicate"], part["sizes"]):
                n = np.array([s["n"] for s in slices], dtype=np.int64)
                draws = np.random.default_rng([seed, 0, int(run)]).multinomial(n.sum(), n / n.sum())
                yield pd.DataFrame({"replicate": run, "slice": [s["slice"] for s in slices], "draws": draws})

    def spread_draws(key: tuple, ids: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        if ids.empty:
            return pd.DataFrame({"object_id": [], "chunk": [], "weights": []})
        names = ids["object_id"].sort_values().to_numpy()
        counts = draws.sort_values("replicate")["draws"].to_numpy()
        own = np.random.default_rng([seed, 1, int(key[0])])
        weights = own.multinomial(counts, np.full(len(names), 1 / len(names))).T.astype(np.int32)
        chunks = [weights[:, i:i + CHUNK] for i in range(0, replicates, CHUNK)]
        return pd.concat([pd.DataFrame({"object_id": names, "chunk": i, "weights": list(w)})
                          for i, w in enumerate(chunks)])

    split = runs.mapInPandas(split_draws, "replicate bigint, slice bigint, draws bigint")
    return sliced.groupBy("slice").cogroup(split.groupBy("slice")).applyInPandas(
        spread_draws, "object_id string, chunk int, weights array<int>")


def _bucket_wins(score: np.ndarray, pos: np.ndarray, neg: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted (positive above negative) pairs inside one bucket per replicate, equal scores counting half."""
    order = np.argsort(score, kind="stable")
    first = np.flatnonzero(np.diff(score[order], prepend=np.nan) != 0)
    w = weights[order].astype(np.float64)
    p = np.add.reduceat(w * pos[order, None], first, axis=0)
    n = np.add.reduceat(w * neg[order, None], first, axis=0)
    return (p * (np.cumsum(n, axis=0) - n / 2)).sum(axis=0)


_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(14)])


def poisson_weights(objects: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """How often each object (a 64-bit hash) is drawn in each replicate: Poisson counts of mean one from a hash of both.

    The same object gets the same counts wherever its rows lie, so nobody has to hand them out.
    """
    h = objects.view(np.uint64)[:, None] + (replicates.astype(np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * _SPREAD[0]
    for factor in _SPREAD[1:]:
        h = (h ^ (h >> np.uint64(33))) * factor
    uniform = ((h ^ (h >> np.uint64(33))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_POISSON, uniform, side="right").astype(np.int32)


def bootstrap_roc_draws(scored: DataFrame, horizon_days: int = HORIZON_DAYS, replicates: int = 500, seed: int = 0,
                        parts: int | None = None, multinomial: bool = False) -> DataFrame:
    """(replicate, roc_auc) with objects, not rows, resampled; draws with a single class are left out.

    Pairs across score buckets follow from weighted totals per bucket, pairs inside a bucket are counted there.
    Buckets holding a single score need totals only and are cut into slices by object. Weights are Poisson counts made from
    a hash where a row lies; with ``multinomial`` every replicate draws exactly as many objects as there are, and the weights
    are handed out by a join.
    """
    rows = scored.where(F.col("score").isNotNull()).withColumn("y", within_horizon("t_to_failure", horizon_days))
    rows = rows.select("object_id", "score", "y")
    rows = with_bucket(rows, "score", parts or parts_for(rows, BUCKET_ROWS))
    rows = rows.groupBy("object_id", "score", "_bucket").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    rows = rows.withColumn("_slice", F.when(F.col("_bucket") % 2 == 1, F.pmod(F.xxhash64("object_id"), F.lit(64)))
                           .otherwise(F.lit(0)))
    kind = "_bucket int, replicate bigint, pos double, neg double, wins double"

    def weighted_sums(bucket: int, part: pd.DataFrame, first: int, w: np.ndarray) -> pd.DataFrame:
        pos, neg = part["pos"].to_numpy(float), part["neg"].to_numpy(float)
        wins = np.zeros(w.shape[1]) if bucket % 2 == 1 else _bucket_wins(part["score"].to_numpy(), pos, neg, w)
        return pd.DataFrame({"_bucket": bucket, "replicate": first + np.arange(w.shape[1]), "pos": pos @ w, "neg": neg @ w,
                             "wins": wins})

    def sum_given(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return weighted_sums(int(key[0]), part, int(key[2]) * CHUNK, np.stack(part["weights"].to_numpy()))

    def sum_hashed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        runs = [np.arange(a, min(a + CHUNK, replicates)) for a in range(0, replicates, CHUNK)]
        return pd.concat([weighted_sums(int(key[0]), part, int(r[0]), poisson_weights(part["_hash"].to_numpy(), r, seed))
                          for r in runs])

    if multinomial:
        given = rows.join(object_weights(scored, replicates, seed), "object_id")
        sums = given.groupBy("_bucket", "_slice", "chunk").applyInPandas(sum_given, kind)
    else:
        hashed = rows.select("_bucket", "_slice", "score", "pos", "neg", F.xxhash64("object_id").alias("_hash"))
        sums = hashed.groupBy("_bucket", "_slice").applyInPandas(sum_hashed, kind)
    sums = sums.groupBy("_bucket", "replicate").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
                                                    F.sum("wins").alias("wins"))
    lower = Window.partitionBy("replicate").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tied = F.when(F.col("_bucket") % 2 == 1, F.col("pos") * F.col("neg") / 2).otherwise(F.lit(0.0))
    sums = sums.withColumn("wins", F.col("wins") + tied
                           + F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0.0)))
    out = sums.groupBy("replicate").agg(F.sum("wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.where("p > 0 and n > 0").select("replicate", (F.col("w") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def bootstrap_roc(scored: DataFrame, horizon_days: int = HORIZON_DAYS, replicates: int = 500, seed: int = 0) -> DataFrame:
    """95 % interval of the ROC-AUC under resampling of objects; one row."""
    return _interval(bootstrap_roc_draws(scored, horizon_days, replicates, seed), "roc_auc", "roc_lo", "roc_hi")
