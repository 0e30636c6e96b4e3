"""Boosted trees over histograms of gradients, with a learned side for missing values and patience on validation days.

Training rows are cut into bins once (quantiles of the training days, one more bin for missing values) and stored in blocks.
A level of a tree is one pass over the blocks: every task sums gradient and hessian by (node, feature, bin), Spark adds the
tasks' sums, and the driver, which sees no rows, picks the splits from that table of bounded size. Of the two children of a split
only the lighter one is summed, the other is what is left of their parent. Each split tries missing values on both sides. The pass that opens a round also counts the validation rows by score, from which the area under the
precision-recall curve of the trees so far follows; training stops after ``patience`` rounds without gain, and the trees of the
best round stay.

Sums are of integers (gradients in units of 2^-20), so they do not depend on the order of tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.session import cut_lineage

BINS = 64
MISSING = 255  # the bin of missing values
BLOCK = 4096
KEPT_TREES = 8  # trees that a pass may have to add to the stored margins
SUM_TASKS = 8  # that add up the tables of a pass
UNIT = float(1 << 20)
SCORE_STEPS = 1 << 14
_BLOCKS = "seed long, n int, bins binary, y binary, val binary, margin binary"
_SUMS = "kind string, node int, feature int, bin int, g long, h long, n long"
_KINDS = {"kind": pa.string(), "node": pa.int32(), "feature": pa.int32(), "bin": pa.int32(), "g": pa.int64(), "h": pa.int64(),
          "n": pa.int64()}


@dataclass
class Tree:
    """A tree as a heap of nodes: children of i are 2i + 1 and 2i + 2; a feature below zero marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray  # the last bin of the left side
    threshold: np.ndarray  # smaller values go left
    missing_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n, bool), np.zeros(n))

    def leaves(self, side) -> np.ndarray:
        """Node of every row; ``side(rows, features, nodes)`` tells which of the rows go left."""
        node = None
        while True:
            if node is None:
                node = side(None, None, None)
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = 2 * at + 2 - side(inner, self.feature[at], at)


def binned_side(tree: Tree, bins: np.ndarray):
    def side(rows, features, nodes):
        if rows is None:
            return np.zeros(len(bins), np.int64)
        x = bins[rows, features]
        return np.where(x == MISSING, tree.missing_left[nodes], x <= tree.cut[nodes])
    return side


def binned_leaves(tree: Tree, columns: np.ndarray) -> np.ndarray:
    """Node of every row as ``tree.leaves`` finds it, from bins stored column by column; every split looks at all rows.

    From the last level up a split turns into a choice between what its children found, one byte a row.
    """
    found = [np.uint8(i) for i in range(len(tree.feature))]
    for i in range(len(found) // 2 - 1, -1, -1):
        f = tree.feature[i]
        if f >= 0:
            goes_left = columns[f] <= np.uint8(tree.cut[i])  # a cut lies below the bin of missing values
            if tree.missing_left[i]:
                goes_left |= columns[f] == MISSING
            found[i] = np.where(goes_left, found[2 * i + 1], found[2 * i + 2])
    return found[0] if tree.feature[0] >= 0 else np.zeros(columns.shape[1], np.uint8)


def value_side(tree: Tree, values: np.ndarray):
    def side(rows, features, nodes):
        if rows is None:
            return np.zeros(len(values), np.int64)
        x = values[rows, features]
        return np.where(np.isnan(x), tree.missing_left[nodes], (x < tree.threshold[nodes]) | np.isinf(tree.threshold[nodes]))
    return side


@dataclass
class BoostedTrees:
    """Trees of the best round; ``score`` is the probability of their summed margin."""

    columns: list[str]
    trees: list[Tree]
    step: float
    gains: list[float]  # area on the validation days after each round that was tried

    def margins(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values))
        for tree in self.trees:
            out += self.step * tree.value[tree.leaves(value_side(tree, values))]
        return out

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Adds ``out``. Arrow batches in, one number a row out; missing columns are an error, missing values are not."""
        model = self

        @F.pandas_udf("double")
        def score(*series: pd.Series) -> pd.Series:
            values = np.column_stack([s.to_numpy(np.float64, na_value=np.nan) for s in series])
            return pd.Series(1 / (1 + np.exp(-model.margins(values))))

        return df.withColumn(out, score(*[F.col(c).cast("double") for c in self.columns]))

    def save(self, path: str) -> None:
        """One row per node, and one row of settings."""
        spark = SparkSession.getActiveSession()
        nodes = [(t, i, int(f), int(c), float(x), bool(m), float(v)) for t, tree in enumerate(self.trees)
                 for i, (f, c, x, m, v) in enumerate(zip(tree.feature, tree.cut, tree.threshold, tree.missing_left, tree.value))]
        spark.createDataFrame(nodes, "tree int, node int, feature int, cut int, threshold double, missing_left boolean, "
                                     "value double").coalesce(1).write.parquet(f"{path}/nodes")
        spark.createDataFrame([(self.columns, self.step, self.gains, len(self.trees))],
                              "columns array<string>, step double, gains array<double>, trees int").coalesce(1).write.parquet(
            f"{path}/settings")

    @staticmethod
    def load(path: str) -> BoostedTrees:
        spark = SparkSession.getActiveSession()
        settings = spark.read.parquet(f"{path}/settings").first()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        trees = [Tree(*(part[c].to_numpy() for c in ("feature", "cut", "threshold", "missing_left", "value")))
                 for _, part in nodes.groupby("tree")]
        return BoostedTrees(list(settings["columns"]), trees, settings["step"], list(settings["gains"]))


def quantile_cuts(df: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """At most ``bins - 1`` thresholds per column, by approximate quantiles of its values: one pass, one small row."""
    probabilities = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    finite = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    row = df.agg(*[F.percentile_approx(finite[c], probabilities, 100 * bins).alias(f"q{i}") for i, c in enumerate(columns)],
                 *[F.min(finite[c]).alias(f"low{i}") for i, c in enumerate(columns)]).first()
    return [sorted({q for q in row[f"q{i}"] or [] if q > row[f"low{i}"]}) for i in range(len(columns))]


def to_bins(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bin of each value: the number of cuts at or below it."""
    out = np.empty(values.shape, np.uint8)
    for i, edges in enumerate(cuts):
        out[:, i] = np.searchsorted(edges, values[:, i], side="right")
    out[np.isnan(values)] = MISSING
    return out


def _blocks(columns: list[str], cuts: list[list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
                bins, n = to_bins(values, cuts), batch.num_rows
                y, val = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() for c in ("_y", "_val"))
                yield pa.RecordBatch.from_pydict({
                    "seed": pa.array([zlib.crc32(bins.tobytes() + y)], pa.int64()), "n": pa.array([n], pa.int32()),
                    "bins": pa.array([bins.T.tobytes()], pa.binary()), "y": pa.array([y], pa.binary()),
                    "val": pa.array([val], pa.binary()), "margin": pa.array([np.zeros(n).tobytes()], pa.binary())})
    return run


@dataclass
class _Pass:
    """What a task needs to know to sum one level of the tree of one round."""

    recent: list[Tree]  # trees that the stored margins lack
    tree: Tree
    level: int
    wanted: np.ndarray  # nodes of the level that are summed
    features: np.ndarray
    step: float
    sample: float
    weight: float
    mark: tuple[int, int]  # seed of the training and number of the round
    n_features: int
    scores: bool  # whether validation rows are counted by score

    def margins(self, columns: np.ndarray, stored: np.ndarray) -> np.ndarray:
        out = stored.copy()
        for tree in self.recent:
            out += (self.step * tree.value)[binned_leaves(tree, columns)]
        return out


def _unpacked(row: dict, n_features: int):
    """Bins column by column, labels, which rows are held out, and stored margins."""
    return (np.frombuffer(row["bins"], np.uint8).reshape(n_features, row["n"]), np.frombuffer(row["y"], np.uint8),
            np.frombuffer(row["val"], np.uint8).astype(bool), np.frombuffer(row["margin"], np.float64))


def _sum_level(job: _Pass):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, nodes = (1 << job.level) - 1, 1 << job.level
        width = nodes * 256
        sums = np.zeros((len(job.features), 2, width))
        counts = np.zeros((2, SCORE_STEPS))
        loss = 0.0
        for batch in batches:
            for row in batch.to_pylist():
                columns, y, val, stored = _unpacked(row, job.n_features)
                drawn = np.random.default_rng([*job.mark, row["seed"]]).random(len(y)) < job.sample
                node = binned_leaves(job.tree, columns).astype(np.int64) - first
                use = np.flatnonzero(~val & drawn & (node >= 0) & job.wanted[np.maximum(node, 0)])
                if job.scores and val.any():
                    held = np.flatnonzero(val)
                    p = 1 / (1 + np.exp(-job.margins(columns[:, held], stored[held])))
                    place = np.minimum((p * SCORE_STEPS).astype(np.int64), SCORE_STEPS - 1)
                    counts += np.stack([np.bincount(place[y[held] == k], minlength=SCORE_STEPS) for k in (0, 1)])
                    loss -= np.log(np.maximum(np.where(y[held] == 1, p, 1 - p), 1e-15)).sum()
                if not len(use):
                    continue
                columns, y = columns[:, use], y[use]
                p = 1 / (1 + np.exp(-job.margins(columns, stored[use])))
                w = np.where(y == 1, job.weight, 1.0)
                g = np.rint(w * (p - y) * UNIT)
                h = np.rint(w * p * (1 - p) * UNIT)
                at = node[use] * 256
                for i, f in enumerate(job.features.tolist()):
                    place = at + columns[f]
                    sums[i, 0] += np.bincount(place, g, width)
                    sums[i, 1] += np.bincount(place, h, width)
        feature, place = np.nonzero(sums.any(axis=1))
        table = {"kind": ["sum"] * len(place), "node": place // 256, "feature": job.features[feature], "bin": place % 256,
                 "g": sums[feature, 0, place], "h": sums[feature, 1, place], "n": np.zeros(len(place))}
        yield _record(table)
        if job.scores:
            at = np.flatnonzero(counts.any(axis=0))
            zero = np.zeros(len(at))
            yield _record({"kind": ["score"] * len(at), "node": zero, "feature": zero, "bin": at, "g": counts[1, at],
                           "h": counts[0, at], "n": counts[:, at].sum(axis=0)})
            yield _record({"kind": ["loss"], "node": [0], "feature": [0], "bin": [0], "g": [np.rint(loss * UNIT)], "h": [0],
                           "n": [0]})
    return run


def _record(table: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(table[c], k) if c == "kind" else pa.array(np.asarray(table[c]).astype(np.int64)).cast(k)
         for c, k in _KINDS.items()], names=list(_KINDS))


def _advance(job: _Pass):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [_unpacked(row, job.n_features) for row in batch.to_pylist()]
            margins = [job.margins(columns, stored).tobytes() for columns, _, _, stored in blocks]
            at = batch.schema.get_field_index("margin")
            yield batch.set_column(at, "margin", pa.array(margins, pa.binary()))
    return run


def precision_recall_area(bad: np.ndarray, good: np.ndarray) -> float:
    """Average precision of counts by falling score; equal scores are one step."""
    hits, seen = np.cumsum(bad), np.cumsum(bad + good)
    return float((bad * hits / np.maximum(seen, 1)).sum() / max(hits[-1], 1)) if len(bad) else 0.0


@dataclass
class Split:
    feature: int
    cut: int
    missing_left: bool
    gain: float
    left: tuple[float, float]  # gradient and hessian
    right: tuple[float, float]


def best_split(sums: np.ndarray, features: np.ndarray, last: list[int], ridge: float, least: float) -> Split | None:
    """The split of one node with the largest gain; ``sums`` are gradient and hessian by (feature, kind, bin).

    Both sides need a hessian of at least ``least``. Missing values are tried on both sides; of equal gains the first
    feature, the lower cut and the right side win.
    """
    def quality(g, h):
        return g * g / (h + ridge)

    found = None
    for i, f in enumerate(features.tolist()):
        lost_g, lost_h = sums[i, 0, MISSING], sums[i, 1, MISSING]
        g, h = sums[i, 0, :last[f] + 1], sums[i, 1, :last[f] + 1]
        whole_g, whole_h = g.sum() + lost_g, h.sum() + lost_h
        for left in (False, True):
            # the last cut parts all values from the missing ones
            gl, hl = np.cumsum(g) + left * lost_g, np.cumsum(h) + left * lost_h
            gr, hr = whole_g - gl, whole_h - hl
            gains = np.where((hl >= least) & (hr >= least), quality(gl, hl) + quality(gr, hr) - quality(whole_g, whole_h), 0.0)
            k = int(gains.argmax()) if len(gains) else 0
            if len(gains) and gains[k] > 1e-6 and (found is None or gains[k] > found.gain):
                found = Split(f, k, left, float(gains[k]), (gl[k], hl[k]), (gr[k], hr[k]))
    return found


class _Trainer:
    def __init__(self, blocks: DataFrame, cuts: list[list[float]], weight: float, depth: int, step: float, sample: float,
                 column_share: float, least: float, ridge: float, seed: int):
        self.blocks, self.cuts, self.weight, self.depth, self.step = blocks, cuts, weight, depth, step
        self.sample, self.column_share, self.least, self.ridge, self.seed = sample, column_share, least, ridge, seed
        self.recent: list[Tree] = []
        self.usable = np.array([i for i, c in enumerate(cuts) if c], np.int64)

    def job(self, tree: Tree, level: int, features: np.ndarray, turn: int, scores: bool, wanted: np.ndarray | None = None) -> _Pass:
        wanted = np.ones(1 << level, bool) if wanted is None else wanted
        return _Pass(self.recent, tree, level, wanted, features, self.step, self.sample, self.weight, (self.seed, turn),
                     len(self.cuts), scores)

    def sums(self, job: _Pass) -> tuple[np.ndarray, list]:
        """Added sums by (node, feature, kind, bin), and the other rows; at most nodes * features * bins of them."""
        key = ["kind", "node", "feature", "bin"]
        # a shuffle that fits the table's size, which is the same for any number of rows
        found = self.blocks.mapInArrow(_sum_level(job), _SUMS).repartition(SUM_TASKS, *key).groupBy(*key).agg(
            F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
        out = np.zeros((1 << job.level, len(job.features), 2, 256))
        place = {f: i for i, f in enumerate(job.features.tolist())}
        rows = found[found["kind"] == "sum"]
        at = rows["feature"].map(place).to_numpy(np.int64)
        for k, c in enumerate("gh"):
            out[rows["node"].to_numpy(), at, k, rows["bin"].to_numpy()] = rows[c].to_numpy() / UNIT
        return out, found[found["kind"] != "sum"]

    def grow(self, turn: int) -> tuple[Tree, object]:
        """One more tree, and how the trees before it do on the validation rows."""
        rng = np.random.default_rng([self.seed, turn])
        many = max(1, round(self.column_share * len(self.usable)))
        features = np.sort(rng.choice(self.usable, min(many, len(self.usable)), replace=False))
        tree, scores, last = Tree.empty(self.depth), None, [len(c) for c in self.cuts]
        for level in range(self.depth):
            whole = sums if level else None
            sums, other = self.sums(self.job(tree, level, features, turn, level == 0, lighter if level else None))
            scores = other if level == 0 else scores
            for node in np.flatnonzero(lighter).tolist() if level else ():
                sums[node ^ 1] = whole[node >> 1] - sums[node]  # exact: whole numbers in units of 2^-20
            first, split_any = (1 << level) - 1, False
            lighter = np.zeros(2 << level, bool)
            for node in range(1 << level):
                split = best_split(sums[node], features, last, self.ridge, self.least)
                i = first + node
                if split is None:
                    continue
                split_any = True
                edges = self.cuts[split.feature]
                tree.feature[i], tree.cut[i], tree.missing_left[i] = split.feature, split.cut, split.missing_left
                tree.threshold[i] = edges[split.cut] if split.cut < len(edges) else np.inf
                for child, (g, h) in ((2 * i + 1, split.left), (2 * i + 2, split.right)):
                    tree.value[child] = -g / (h + self.ridge)
                lighter[2 * node + int(split.right[1] < split.left[1])] = True
            if not split_any:
                break
        return tree, scores

    def keep(self, tree: Tree, turn: int) -> None:
        """Later passes add the tree to the stored margins; once there are many, new margins are written."""
        self.recent = [*self.recent, tree]
        if len(self.recent) == KEPT_TREES:
            self.blocks = cut_lineage(self.blocks.mapInArrow(_advance(self.job(tree, 0, self.usable, turn, False)), _BLOCKS))
            self.recent = []


def binned_blocks(train: DataFrame, val: DataFrame, columns: list[str], cuts: list[list[float]], label: str) -> DataFrame:
    """Both frames as written blocks with margins of zero, dealt out evenly to all cores: else every pass would keep only as
    many tasks busy as the small rows fill files."""
    def rows(df: DataFrame, held: bool) -> DataFrame:
        return df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)],
                         F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("_y"), F.lit(held).alias("_val"))

    names = [f"_{i}" for i in range(len(columns))]
    blocks = rows(train, False).unionByName(rows(val, True)).mapInArrow(_blocks(names, cuts), _BLOCKS)
    return cut_lineage(blocks.repartition(train.sparkSession.sparkContext.defaultParallelism))


def first_splits(df: DataFrame, columns: list[str], cuts: list[list[float]], label: str = "y", weight: float = 1.0,
                 ridge: float = 1.0, least: float = 5.0) -> DataFrame:
    """The best first split of every column on its own: feature, threshold, missing_left, gain, and the values of both leaves."""
    blocks = binned_blocks(df, df.limit(0), columns, cuts, label)
    trainer = _Trainer(blocks, cuts, weight, 1, 1.0, 1.0, 1.0, least, ridge, 0)
    sums, _ = trainer.sums(trainer.job(Tree.empty(1), 0, trainer.usable, 0, False))
    found = []
    for i, f in enumerate(trainer.usable.tolist()):
        split = best_split(sums[0, i:i + 1], np.array([f]), [len(c) for c in cuts], ridge, least)
        if split:
            at = float(cuts[f][split.cut]) if split.cut < len(cuts[f]) else None
            found.append((columns[f], at, split.missing_left, split.gain, *(-g / (h + ridge) for g, h in (split.left, split.right))))
    rows = [(f, t, m, float(gain), float(x), float(y)) for f, t, m, gain, x, y in found]
    return df.sparkSession.createDataFrame(rows, "feature string, threshold double, missing_left boolean, gain double, "
                                                 "left_value double, right_value double")


def validation_quality(found) -> float:
    """Area under the precision-recall curve; without both kinds of days the negative mean loss, without any day zero."""
    scores = found[found["kind"] == "score"].sort_values("bin", ascending=False)
    bad, good = scores["g"].to_numpy(np.float64), scores["h"].to_numpy(np.float64)
    if bad.sum() and good.sum():
        return precision_recall_area(bad, good)
    rows = bad.sum() + good.sum()
    return float(-found.loc[found["kind"] == "loss", "g"].sum() / UNIT / rows) if rows else 0.0


def train_boosted(train: DataFrame, val: DataFrame, columns: list[str], label: str = "y", weight: float = 1.0, rounds: int = 1000,
                  patience: int = 50, depth: int = 4, step: float = 0.05, sample: float = 0.8, column_share: float = 0.8,
                  least: float = 5.0, ridge: float = 1.0, bins: int = BINS, seed: int = 42) -> BoostedTrees:
    """Boosted trees on ``train`` that stop by ``val``; ``weight`` counts every positive row that often.

    Missing values and NaN go to the side that a split learned for them; columns without two different values are not used.
    """
    cuts = quantile_cuts(train, columns, bins)

    blocks = binned_blocks(train, val, columns, cuts, label)
    trainer = _Trainer(blocks, cuts, weight, depth, step, sample, column_share, least, ridge, seed)
    trees: list[Tree] = []
    gains: list[float] = []
    best, best_round = -np.inf, 0
    while len(trainer.usable):
        tree, scores = trainer.grow(len(trees))
        if trees:  # how the trees up to the last round do
            gains.append(validation_quality(scores))
            if gains[-1] > best:
                best, best_round = gains[-1], len(trees)
            if len(trees) - best_round >= patience:
                break
        if len(trees) == rounds or tree.feature[0] < 0:
            break
        trees.append(tree)
        trainer.keep(tree, len(trees))
    return BoostedTrees(list(columns), trees[:best_round], step, gains)
