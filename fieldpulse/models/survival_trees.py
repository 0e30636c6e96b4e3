"""A forest of survival trees: splits by the log-rank statistic, mortality per leaf.

Objects are cut into bins once (columns by quantiles, durations by the days of failures). Every tree draws its objects with
replacement by a hash, at most ``tree_rows`` of them on average, and is grown in a task of its own; trees do not meet. A split
is chosen among a few drawn columns from a table of (bin of the column, bin of the duration): deaths and numbers at risk on
both sides of every cut at once. A leaf's mortality is its cumulative hazard summed over the days of failures, and the forest
answers with the mean over its trees: higher means an earlier failure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.models.boosting import quantile_cuts, to_bins
from fieldpulse.models.prep import medians
from fieldpulse.session import cut_lineage

BINS = 32
TIME_BINS = 256
TREE_ROWS = 50_000
MOST_COPIES = 12  # of one object in one tree; the chance of more is below 10^-10
NODE = ("feature", "cut", "left", "right", "value")
_NODES = "tree int, place int, feature int, cut int, left int, right int, value double"
_BINNED = "key long, bins binary, time int, event int"


def log_rank(deaths: np.ndarray, rows: np.ndarray, leaf: int) -> np.ndarray:
    """Squared log-rank statistic of every cut of a column; both tables are (bin of the column, bin of the duration).

    Cut k puts bins 0 to k on the left. Cuts that leave fewer than ``leaf`` rows on a side get zero.
    """
    left_deaths, left_rows = np.cumsum(deaths, axis=0)[:-1], np.cumsum(rows, axis=0)[:-1]
    left_risk = np.cumsum(left_rows[:, ::-1], axis=1)[:, ::-1]
    all_deaths = deaths.sum(axis=0)
    risk = np.cumsum(rows.sum(axis=0)[::-1])[::-1]
    share = left_risk / np.maximum(risk, 1)
    expected = share * all_deaths
    spread = share * (1 - share) * all_deaths * (risk - all_deaths) / np.maximum(risk - 1, 1)
    gap, variance = (left_deaths - expected).sum(axis=1), spread.sum(axis=1)
    n = left_rows.sum(axis=1)
    usable = (n >= leaf) & (rows.sum() - n >= leaf) & (variance > 0)
    return np.where(usable, gap * gap / np.where(variance > 0, variance, 1.0), 0.0)


def mortality(deaths: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> float:
    """Cumulative hazard by bin of the duration, summed over the days of failures (``weights`` of them a bin)."""
    risk = np.cumsum(rows[::-1])[::-1]
    return float((np.cumsum(deaths / np.maximum(risk, 1)) * weights).sum())


def grow(bins: np.ndarray, time: np.ndarray, event: np.ndarray, weights: np.ndarray, leaf: int, many: int, rng) -> dict[str, list]:
    """One tree over rows that may repeat; of every node ``many`` columns are tried, the first of equal splits stays."""
    n_time = len(weights)
    nodes: dict[str, list] = {name: [] for name in NODE}
    work = [(np.arange(len(time)), None, "")]
    while work:
        rows, parent, side = work.pop()
        here = len(nodes["feature"])
        if parent is not None:
            nodes[side][parent] = here
        gain, feature, cut = 0.0, -1, 0
        dead = event[rows]
        if len(rows) >= 2 * leaf and dead.any():
            for f in rng.choice(bins.shape[1], many, replace=False).tolist():
                x = bins[rows, f].astype(np.int64)
                width = int(x.max()) + 1
                if width < 2:
                    continue
                place = x * n_time + time[rows]
                found = log_rank(*(np.bincount(place, w, width * n_time).reshape(width, n_time) for w in (dead, None)), leaf)
                if found.max() > gain:
                    gain, feature, cut = float(found.max()), f, int(found.argmax())
        value = 0.0
        if feature < 0:
            value = mortality(np.bincount(time[rows], dead, n_time), np.bincount(time[rows], minlength=n_time), weights)
        else:
            left = bins[rows, feature] <= cut
            work += [(rows[~left], here, "right"), (rows[left], here, "left")]
        for name, x in zip(NODE, (feature, cut, -1, -1, value)):
            nodes[name].append(x)
    return nodes


@dataclass
class SurvivalForest:
    """Trees as tables of nodes: ``left`` and ``right`` are places in the table, a feature below zero marks a leaf."""

    columns: list[str]
    medians: list[float]
    cuts: list[list[float]]
    trees: list[dict[str, np.ndarray]]

    def scores(self, values: np.ndarray) -> np.ndarray:
        bins, total = to_bins(values, self.cuts), np.zeros(len(values))
        for tree in self.trees:
            at = np.zeros(len(values), np.int64)
            while True:
                inner = np.flatnonzero(tree["feature"][at] >= 0)
                if not len(inner):
                    break
                here = at[inner]
                goes_left = bins[inner, tree["feature"][here]] <= tree["cut"][here]
                at[inner] = np.where(goes_left, tree["left"][here], tree["right"][here])
            total += tree["value"][at]
        return total / max(len(self.trees), 1)

    def transform(self, df: DataFrame, out: str = "chronic_score") -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def score(*series: pd.Series) -> pd.Series:
            return pd.Series(model.scores(np.column_stack([s.to_numpy(np.float64) for s in series])))

        if not self.columns:
            return df.withColumn(out, F.lit(0.0))
        return df.withColumn(out, score(*[F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(self.columns, self.medians)]))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        tables = [pd.DataFrame(n).assign(tree=t, place=range(len(n["feature"]))) for t, n in enumerate(self.trees)]
        columns = [part.split()[0] for part in _NODES.split(", ")]
        spark.createDataFrame(pd.concat(tables)[columns], _NODES).coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(self.columns, self.medians, self.cuts)],
                              "columns array<string>, medians array<double>, cuts array<array<double>>").coalesce(1).write.parquet(
            f"{path}/settings")

    @staticmethod
    def load(path: str) -> SurvivalForest:
        spark = SparkSession.getActiveSession()
        settings = spark.read.parquet(f"{path}/settings").first()
        return SurvivalForest(list(settings["columns"]), list(settings["medians"]), [list(c) for c in settings["cuts"]],
                              as_trees(spark.read.parquet(f"{path}/nodes")))


def as_trees(nodes: DataFrame) -> list[dict[str, np.ndarray]]:
    found = nodes.toPandas().sort_values(["tree", "place"])
    return [{c: part[c].to_numpy() for c in NODE} for _, part in found.groupby("tree")]


def _binned(names: list[str], cuts: list[list[float]], days: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])
            bins = to_bins(values, cuts)
            time = np.searchsorted(days, batch.column("_days").to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array([row.tobytes() for row in bins], pa.binary()), pa.array(time.astype(np.int32)),
                 batch.column("_event")], names=["key", "bins", "time", "event"])
    return run


def _grown(n_time: int, leaf: int, seed: int):
    weights = np.r_[0.0, np.ones(n_time - 1)]  # before the first failure there is no hazard

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")  # the same tree however the rows arrive
        bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(len(rows), -1)
        at = np.repeat(np.arange(len(rows)), rows["copies"].to_numpy())
        many = max(1, round(math.sqrt(bins.shape[1])))
        nodes = grow(bins[at], rows["time"].to_numpy()[at], rows["event"].to_numpy()[at].astype(float), weights, leaf, many,
                     np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame({"tree": int(key[0]), "place": range(len(nodes["feature"])), **nodes})
    return run


def failure_days(objects: DataFrame, most: int = TIME_BINS) -> list[float]:
    """All days of failures if they are few, else their quantiles."""
    failed = objects.where("event = 1").select(F.col("duration").cast("double").alias("duration"))
    days = [r[0] for r in failed.distinct().limit(most).collect()]
    return sorted(days) if len(days) < most else quantile_cuts(failed, ["duration"], most)[0]


def log_rank_of_cuts(objects: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """(cut, statistic): how well objects below and from each cut on are told apart by their durations, without a least size.

    Summed by (bin, duration), a table of a row per cut and day of the history.
    """
    at = sum(((F.col(column) >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    table = objects.groupBy(at.alias("bin"), "duration").agg(F.sum("event").alias("deaths"), F.count("*").alias("n")).toPandas()
    days = np.sort(table["duration"].unique())
    place = (table["bin"].to_numpy(), np.searchsorted(days, table["duration"].to_numpy()))
    deaths, rows = np.zeros((len(cuts) + 1, len(days))), np.zeros((len(cuts) + 1, len(days)))
    deaths[place], rows[place] = table["deaths"], table["n"]
    found = log_rank(deaths, rows, 1)
    return objects.sparkSession.createDataFrame([(float(c), float(x)) for c, x in zip(cuts, found)], "cut double, statistic double")


def train_forest(objects: DataFrame, features: list[str], trees: int = 200, leaf: int = 20, seed: int = 42,
                 tree_rows: int = TREE_ROWS) -> SurvivalForest:
    """A forest on one row per object (object_id, duration, event, features); missing values become the median."""
    filling = medians(objects, [c for c in features if c in objects.columns])
    columns = list(filling)
    if not columns:
        return SurvivalForest([], [], [], [])
    filled = objects.select(F.xxhash64(F.col("object_id").cast("string")).alias("_key"),
                            F.col("duration").cast("double").alias("_days"), F.col("event").cast("int").alias("_event"),
                            *[F.coalesce(F.col(c).cast("double"), F.lit(filling[c])).alias(f"_{i}") for i, c in enumerate(columns)])
    names = [f"_{i}" for i in range(len(columns))]
    cuts, days = quantile_cuts(filled, names, BINS), failure_days(objects)
    rows = cut_lineage(filled.mapInArrow(_binned(names, cuts, days), _BINNED))
    rate = min(1.0, tree_rows / max(rows.count(), 1))
    chance = (F.xxhash64("key", "tree", F.lit(seed)).cast("double") / 2.0**64) + 0.5
    below = np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(MOST_COPIES)]).tolist()
    copies = sum(((chance >= F.lit(p)).cast("int") for p in below), F.lit(0))
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("copies", copies).where("copies > 0")
    nodes = drawn.groupBy("tree").applyInPandas(_grown(len(days) + 1, leaf, seed), _NODES)
    return SurvivalForest(columns, [filling[c] for c in columns], cuts, as_trees(nodes))
