"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors of a label are one node. Spherical k-means, fitted on a bounded sample, gives every node the cell of its nearest
centre. Nodes so close to the centre that any two of them must be linked (its core) need no products: they are linked to one of
them and counted as a whole, and stay away unless a node outside the core lies near enough to be linked with one of them.

The rest of a label is cut along its cells into blocks of bounded size, the fewer the better; most labels are one block. Two
vectors with a cosine of at least t are at most s = sqrt(2 - 2t) apart; if they lie in different cells, the plane between the two
centres passes between them, so neither is farther than s from it. So a node visits the blocks of the cells that it lies near
enough to, in one direction of the circle of blocks: every pair is met once, in the home block of one of its ends, and no link is
lost, whatever the centres.

Within a block nodes are grouped around leaders. Visitors come as a stream, and a tight group only meets those that lie within
its radius and the angle of the threshold. Products are in single precision; what comes near the threshold is measured again in
double precision. A task answers with the number of links of each row and with ties that hold its groups together, not with pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.components import components
from fieldpulse.session import cut_lineage

COSINE = 0.93
SAMPLE_ROWS = 20_000  # vectors that the centres are fitted on
CELL_ROWS = 1024  # nodes of one label that a cell is meant to hold
MOST_CENTRES = 4096  # beyond it cells grow and are cut into more blocks; the result is the same
BLOCK_ROWS = 2048  # nodes below which a block is not cut further
BLOCK_BYTES = 1 << 24  # that the nodes of a block take at most, in double precision
TILE = 1024  # rows of a product
GROUP_ROWS = 64  # rows of a block to a leader
MOST_LEADERS = 1024
TIGHT = math.radians(80)  # a group meets a chosen few if its radius and the angle of the threshold are less together
MOST_TASKS = 4096
ROUNDING = 1e-9  # by which every bound errs on the safe side
_FOUND = "node long, links long, a long, b long"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def unit_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one in double precision, zeros added up to ``width``, and the original lengths of the lists."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    if len(flat):
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True, initial=0.0)  # no overflow in the squares
    return out / np.linalg.norm(out, axis=1, keepdims=True), sizes


def thinned(centres: np.ndarray, cosine: float) -> np.ndarray:
    """Centres of which no two are so close that they would share one dense group; the first ones stay."""
    kept: list[int] = []
    for i in range(len(centres)):
        if not kept or (centres[kept] @ centres[i]).max() < cosine:
            kept.append(i)
    return centres[kept]


def fit_centres(vectors: DataFrame, count: int, width: int, cosine: float, share: float = 1.0) -> np.ndarray:
    """At most ``count`` unit centres of a spherical k-means over a share of the vectors, chosen by a hash."""
    chosen = vectors.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(share * (1 << 30)))
    scaled = chosen.withColumn("top", F.array_max(F.transform("vec", F.abs))).select(F.concat(
        F.transform("vec", lambda x: x.cast("double") / F.col("top")),
        F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vec"))).alias("v"))
    sample = cut_lineage(scaled).select(array_to_vector("v").alias("features"))
    centres = np.array(KMeans(k=count, distanceMeasure="cosine", maxIter=8, seed=1).fit(sample).clusterCenters())
    norms = np.linalg.norm(centres, axis=1)
    return thinned(centres[norms > 0] / norms[norms > 0][:, None], cosine)


def _gaps(centres: np.ndarray) -> np.ndarray | None:
    return np.linalg.norm(centres[:, None, :] - centres[None], axis=2) if len(centres) < 512 else None


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _place(centres: np.ndarray, cosine: float):
    """Adds the home cell, the cosine to its centre, whether the row is of its core, and cells whose core may reach it."""
    angle = math.acos(cosine)
    core_at, near_at = math.cos(angle / 2) + ROUNDING, math.cos(min(1.5 * angle, math.pi)) - ROUNDING

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x, _ = unit_vectors(batch.column("vec"), centres.shape[1])
            close = x @ centres.T
            home = close.argmax(axis=1)
            best = close[np.arange(len(x)), home]
            row, cell = np.nonzero(close >= near_at)
            edges = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
            kept = [batch.column(c) for c in ("node", "label", "dim", "copies")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(home.astype(np.int32)), pa.array(best), pa.array(best >= core_at),
                 pa.ListArray.from_arrays(pa.array(edges), pa.array(cell.astype(np.int32)))],
                names=["node", "label", "dim", "copies", "home", "best", "core", "near"])
    return run


@dataclass
class _Layout:
    """How the cells of a label that is more than one block follow each other."""

    first: int  # number of its first block
    blocks: int
    cells: np.ndarray  # in rising order
    start: np.ndarray  # rows in the cells before
    rows: np.ndarray
    reach: np.ndarray  # smallest cosine of a row to the centre of its cell

    def at(self, place: np.ndarray) -> np.ndarray:
        whole = self.start[-1] + self.rows[-1]
        return np.minimum((place * self.blocks / whole).astype(np.int64), self.blocks - 1)

    def home(self, cell: np.ndarray, node: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.cells, cell)
        share = (node.astype(np.uint64) * _SPREAD >> np.uint64(11)).astype(np.float64) / (1 << 53)
        return self.at(self.start[i] + share * self.rows[i])

    def visited(self, allowed: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Rows by blocks, true where a row of block ``own`` goes; of two blocks the same one always visits the other."""
        low, high = self.at(self.start.astype(np.float64)), self.at((self.start + self.rows).astype(np.float64))
        covers = (np.arange(self.blocks) >= low[:, None]) & (np.arange(self.blocks) <= high[:, None])
        reached = allowed[:, self.cells].astype(np.float32) @ covers.astype(np.float32) > 0
        ahead = (own[:, None] - np.arange(self.blocks)) % self.blocks
        one_way = (2 * ahead < self.blocks) | ((2 * ahead == self.blocks) & (own[:, None] > np.arange(self.blocks)))
        return reached & one_way & (ahead > 0)


def _layouts(shipped: DataFrame, block: int) -> dict:
    """Layouts by (label, dim) of labels with more rows than a block: a row per label and cell, for these labels only."""
    cells = shipped.groupBy("label", "dim", "home").agg(F.count("*").alias("n"), F.min("best").alias("reach"))
    large = shipped.groupBy("label", "dim").count().where(F.col("count") > block).select("label", "dim")
    table = cells.join(large, ["label", "dim"]).orderBy("label", "dim", "home").toPandas()
    found, first = {}, 0
    for key, part in table.groupby(["label", "dim"], sort=True):
        n = part["n"].to_numpy(np.int64)
        found[key] = _Layout(first, -(-int(n.sum()) // block), part["home"].to_numpy(np.int64), np.cumsum(n) - n, n,
                             part["reach"].to_numpy(np.float64))
        first += found[key].blocks
    return found


def _groups(label: pa.Array, *numbers: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows (first, behind the last) that agree in the label and the numbers."""
    code = label.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    for x in numbers:
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new).tolist()
    return zip(starts, [*starts[1:], len(code)])


def _deal(centres: np.ndarray, cosine: float, layouts: dict, tasks: int):
    """A row for the home block of every node and one for every block that it visits."""
    gaps, apart_most, angle = _gaps(centres), math.sqrt(2 - 2 * cosine), math.acos(cosine)
    bounds = {key: np.cos(np.minimum(np.arccos(np.clip(y.reach, -1, 1)) + angle, math.pi)) - ROUNDING for key, y in layouts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            order = pa.RecordBatch.from_arrays([batch.column("label"), batch.column("dim")], names=["label", "dim"])
            batch = batch.take(pa.compute.sort_indices(order, sort_keys=[("label", "ascending"), ("dim", "ascending")]))
            n = batch.num_rows
            dim, home, node = (batch.column(c).to_numpy() for c in ("dim", "home", "node"))
            block, task = np.zeros(n, np.int64), np.zeros(n, np.int64)
            rows, blocks, where = [np.arange(n)], [block], [task]
            close = None
            for first, behind in _groups(batch.column("label"), dim):
                label, some = batch.column("label")[first].as_py(), slice(first, behind)
                layout = layouts.get((label, int(dim[first])))
                if layout is None:
                    task[some] = zlib.crc32(f"{dim[first]} {label}".encode()) % tasks
                    continue
                if close is None:
                    x, _ = unit_vectors(batch.column("vec"), centres.shape[1])
                    close = x @ centres.T
                    best = close[np.arange(n), home]
                block[some] = layout.home(home[some], node[some])
                task[some] = layout.first + block[some]
                apart = gaps[home[some]] if gaps is not None else np.sqrt(np.maximum(2 - 2 * centres[home[some]] @ centres.T, 0))
                allowed = best[some, None] - close[some] <= apart_most * apart + ROUNDING
                allowed[:, layout.cells] &= close[some][:, layout.cells] >= bounds[label, int(dim[first])]
                row, to = np.nonzero(layout.visited(allowed, block[some]))
                rows.append(first + row)
                blocks.append(to)
                where.append(layout.first + to)
            every = np.concatenate(rows)
            out = batch.take(pa.array(every))
            core = np.where(batch.column("core").to_numpy(zero_copy_only=False), home, -1)[every].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array((np.concatenate(where) % tasks).astype(np.int32)), out.column("label"), out.column("dim"),
                 pa.array(np.concatenate(blocks).astype(np.int32)), pa.array(np.arange(len(every)) >= n),
                 out.column("node"), pa.array(core), out.column("copies"), out.column("vec")],
                names=["task", "label", "dim", "block", "visits", "node", "core", "copies", "vec"])
    return run


def _merged(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between rows a[k] and b[k] those that join groups; ``group`` is kept up to date, its labels only fall."""
    found_a, found_b = [], []
    while True:
        low, high = np.minimum(group[a], group[b]), np.maximum(group[a], group[b])
        new = low != high
        if not new.any():
            return np.concatenate([a[:0], *found_a]), np.concatenate([b[:0], *found_b])
        a, b, low, high = a[new], b[new], low[new], high[new]
        # every group takes one link to a smaller one, so the links taken form no circle
        pick = np.full(len(group), -1)
        pick[high] = np.arange(len(a))
        taken = pick[pick >= 0]
        found_a.append(a[taken])
        found_b.append(b[taken])
        parent = np.arange(len(group))
        parent[high[taken]] = low[taken]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        group[:] = parent[group]


def spanning_links(met: np.ndarray, group: np.ndarray, shift: int, other: int) -> list[tuple[int, int]]:
    """Links that join groups, of the rows ``shift + i`` and ``other + j`` where met[i, j]; ``group`` is kept up to date."""
    i, j = np.nonzero(met)
    return list(zip(*(x.tolist() for x in _merged(i + shift, j + other, group))))


class _Block:
    """The rows of a block at home. Rows of the same core do not meet, they are counted elsewhere."""

    def __init__(self, rows: list[pa.RecordBatch], dim: int, cosine: float):
        self.dim, self.cosine, self.angle = dim, cosine, math.acos(cosine)
        self.slack = (dim + 8) * 2.0 ** -23  # of products in single precision, in and out
        x, core, copies, node = self._columns(rows)
        order, edges = self._ordered(x, core)
        self.x, self.core, self.copies, self.node = x[order], core[order], copies[order], node[order]
        self.single = self.x.astype(np.float32)
        self.counts = np.zeros(len(x), np.int64)
        self.group = np.arange(len(x) + TILE)
        self._tile(edges)

    def _columns(self, rows: list[pa.RecordBatch]):
        x = np.concatenate([unit_vectors(r.column("vec"), self.dim)[0] for r in rows])
        return x, *(np.concatenate([r.column(c).to_numpy() for r in rows]) for c in ("core", "copies", "node"))

    def _ordered(self, x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of rows by core and nearest leader, and where groups start."""
        leader = np.zeros(len(x), np.int64)
        count = min(len(x) // GROUP_ROWS, MOST_LEADERS)
        if count > 1:
            leaders = thinned(x[np.linspace(0, len(x) - 1, count).astype(np.int64)], self.cosine).astype(np.float32)
            for at in range(0, len(x), TILE):
                leader[at:at + TILE] = (x[at:at + TILE].astype(np.float32) @ leaders.T).argmax(axis=1)
        order = np.lexsort((leader, core))
        new = (np.diff(core[order], prepend=-2) != 0) | (np.diff(leader[order], prepend=-1) != 0)
        return order, np.flatnonzero(new)

    def _tile(self, edges: np.ndarray) -> None:
        """Tiles of a tight group each, with the cosine to its middle that a partner must have; others are joined."""
        sums = np.add.reduceat(self.x, edges, axis=0)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        middles = sums / np.where(norms > 0, norms, 1.0)
        ends = np.append(edges[1:], len(self.x))
        near = np.minimum.reduceat(np.einsum("ij,ij->i", self.x, np.repeat(middles, ends - edges, axis=0)), edges)
        radius = np.arccos(np.clip(near - ROUNDING, -1.0, 1.0)) + self.angle
        tight = (radius < TIGHT) & (norms[:, 0] > 0)
        self.tiles: list[tuple[int, int, int]] = []  # first row, behind the last, number of the middle or -1
        open_at = None
        for k, (first, behind) in enumerate(zip(edges.tolist(), ends.tolist())):
            if tight[k] and open_at is not None:
                self._cut(open_at, first, -1)
                open_at = None
            if tight[k]:
                self._cut(first, behind, k)
            elif open_at is None:
                open_at = first
        if open_at is not None:
            self._cut(open_at, len(self.x), -1)
        self.middles = middles.astype(np.float32)
        self.bounds = (np.cos(np.minimum(radius, math.pi)) - ROUNDING - self.slack).astype(np.float32)

    def _cut(self, first: int, behind: int, middle: int) -> None:
        self.tiles += [(at, min(at + TILE, behind), middle) for at in range(first, behind, TILE)]

    def among(self) -> None:
        """Rows at home meet each other."""
        for at in range(0, len(self.x), TILE):
            rows = np.arange(at, min(at + TILE, len(self.x)))
            for i, j in self._links(self.x[rows], self.single[rows], self.core[rows], at):
                i = i + at
                self.counts += np.bincount(i, self.copies[j], len(self.x)).astype(np.int64)
                self.counts += np.bincount(j, self.copies[i], len(self.x)).astype(np.int64)
                _merged(i, j, self.group[:len(self.x)])

    def visit(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Visitors meet rows at home; answers with their links and a tie to the first row of the group they join."""
        n = len(self.x)
        for some in _slices(iter([batch]), TILE):
            x, core, copies, node = self._columns([some])
            counts = np.zeros(len(x), np.int64)
            self.group[n:] = np.arange(n, len(self.group))
            for i, j in self._links(x, x.astype(np.float32), core, None):
                self.counts += np.bincount(j, copies[i], n).astype(np.int64)
                counts += np.bincount(i, self.copies[j], len(x)).astype(np.int64)
                _merged(i + n, j, self.group)
            joined = np.flatnonzero(counts)
            if len(joined):
                yield _found(a=node[joined], b=self.node[self.group[n + joined]])
                yield _found(node=node[joined], links=counts[joined])

    def totals(self) -> Iterator[pa.RecordBatch]:
        """Links of rows at home, and their ties to the first row of their group."""
        label = self.group[:len(self.x)]
        tied = np.flatnonzero(label != np.arange(len(label)))
        yield _found(a=self.node[tied], b=self.node[label[tied]])
        yield _found(node=self.node[self.counts > 0], links=self.counts[self.counts > 0])

    def _links(self, x: np.ndarray, single: np.ndarray, core: np.ndarray, at: int | None):
        """Rows i and rows at home j that are linked; rows that are at home themselves from ``at`` on meet later rows only."""
        reached = single @ self.middles.T >= self.bounds
        for first, behind, middle in self.tiles:
            if at is not None and behind <= at:
                continue
            rows = np.flatnonzero(reached[:, middle]) if middle >= 0 else np.arange(len(x))
            if middle >= 0 and self.core[first] >= 0:  # a group of a core is of one core
                rows = rows[core[rows] != self.core[first]]
            if not len(rows):
                continue
            product = single[rows] @ self.single[first:behind].T
            flat = np.flatnonzero(product >= self.cosine - self.slack)
            i, j = np.divmod(flat, behind - first)
            unsure = np.flatnonzero(product.ravel()[flat] <= self.cosine + self.slack)
            i, j = rows[i], j + first
            good = (core[i] < 0) | (core[i] != self.core[j])
            if at is not None:
                good &= j > i + at
            unsure = unsure[good[unsure]]
            for k in range(0, len(unsure), 1 << 14):
                part = unsure[k:k + (1 << 14)]
                good[part] = np.einsum("ij,ij->i", x[i[part]], self.x[j[part]]) >= self.cosine
            if good.any():
                yield i[good], j[good]


def _found(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], pa.int64()) if c in columns else pa.nulls(n, pa.int64()) for c in ("node", "links", "a", "b")],
        names=["node", "links", "a", "b"])


def _blocks(cosine: float):
    """Answers of blocks that come one after the other, each with its rows at home first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, waiting, block = None, [], None

        def opened() -> _Block:
            return _Block(waiting, place[1], cosine)

        for batch in batches:
            dim, number = (batch.column(c).to_numpy() for c in ("dim", "block"))
            visits = batch.column("visits").to_numpy(zero_copy_only=False)
            for first, behind in _groups(batch.column("label"), dim, number, visits):
                key = (batch.column("label")[first].as_py(), int(dim[first]), int(number[first]))
                if key != place:
                    if waiting:
                        block = opened()
                        block.among()
                    if block is not None:
                        yield from block.totals()
                    place, waiting, block = key, [], None
                rows = batch.slice(first, behind - first)
                if not visits[first]:
                    waiting.append(rows)
                    continue
                if waiting:
                    block = opened()
                    block.among()
                    waiting = []
                if block is not None:  # a block that nobody lives in has no partners
                    yield from block.visit(rows)
        if waiting:
            block = opened()
            block.among()
        if block is not None:
            yield from block.totals()
    return run


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cosine: float = COSINE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
                 most_centres: int = MOST_CENTRES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    Two rows are linked when their labels are equal and not null and their vectors, in double precision, have a cosine of at
    least ``cosine`` (above 0). Null, empty or zero vectors, vectors that hold null or a non-finite number, and rows without
    a label are linked with nothing; vectors of different lengths are never linked. n_links counts other rows, repeated ones
    too. component_id is the smallest key reachable (a null key is larger than all others), kept is true where it is the row's
    own key (of repeated rows with the same key: all of them; a null key is kept if no row with a key is reachable). Other
    columns are neither read nor returned; an empty table gives no rows. The result does not depend on the centres.
    """
    spark = table.sparkSession
    sound = (F.col("vec").isNotNull() & F.col("label").isNotNull()
             & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
             & F.exists("vec", lambda x: x != 0))
    kind = table.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    zero = F.lit(0).cast(kind[6:-1])  # added to -0.0 it makes 0.0
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                        F.col(vector).cast(kind).alias("vec")).select(
        F.monotonically_increasing_id().alias("row"), "id", "label",
        F.when(sound, F.transform("vec", lambda x: x + zero)).alias("vec"))
    rows = cut_lineage(rows.withColumn("digest", F.sha2(F.col("vec").cast("string"), 256)))
    nodes = cut_lineage(rows.where("vec IS NOT NULL").groupBy("label", "digest").agg(
        F.min("row").alias("node"), F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("vec").alias("vec"))
        .withColumn("dim", F.size("vec")))
    shape = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(
        F.max("dim").alias("width"), F.max("n").alias("most"), F.sum("n").alias("n")).first()
    if shape["n"]:
        count = min(max(2, math.ceil(shape["most"] / cell_rows)), most_centres)
        centres = fit_centres(nodes.select("vec"), count, shape["width"], cosine, min(1.0, sample_rows / shape["n"]))
        links, ties = _linked(nodes, centres, cosine, block_rows, shape["width"])
    else:
        links = spark.createDataFrame([], "node long, links long")
        ties = spark.createDataFrame([], "a long, b long")
    groups = nodes.select("label", "digest", "node", "id", "copies").join(components(ties), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    lowest = groups.groupBy("root").agg(F.min("id").alias("low"))
    judged = cut_lineage(groups.join(lowest, "root").join(
        links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").select(
        "label", "digest", "low", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    found = rows.select("id", "label", "digest").join(judged, ["label", "digest"], "left")
    lowest_id = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("low"))
    return found.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                        lowest_id.alias("component_id"), F.col("id").eqNullSafe(lowest_id).alias("kept"))


def _linked(nodes: DataFrame, centres: np.ndarray, cosine: float, block_rows: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) to other nodes, weighted by their copies, and ties (a, b) that hold linked nodes together."""
    spark = nodes.sparkSession
    label, place = nodes.schema["label"].dataType.simpleString(), ["label", "dim"]
    nodes = nodes.select("node", "label", F.col("dim").cast("int").alias("dim"), F.col("copies").cast("long").alias("copies"), "vec")
    placed = cut_lineage(nodes.mapInArrow(_place(centres, cosine), (
        f"node long, label {label}, dim int, copies long, home int, best double, core boolean, near array<int>")))
    # cells as a whole: the core, and whether anything else could be linked with it
    touched = placed.where("size(near) > 0").select("label", "dim", "home", "core", F.explode("near").alias("cell")).where(
        ~(F.col("core") & (F.col("home") == F.col("cell")))).select("label", "dim", F.col("cell").alias("home")).distinct()
    cells = cut_lineage(placed.where("core").groupBy("label", "dim", "home").agg(
        F.sum("copies").alias("core_copies"), F.min("node").alias("centre_node")).join(
        touched.withColumn("touched", F.lit(True)), ["label", "dim", "home"], "left"))
    core = placed.where("core").join(cells, ["label", "dim", "home"])
    whole = core.select("node", (F.col("core_copies") - F.col("copies")).alias("links"))
    stars = core.where("node <> centre_node").select(F.col("node").alias("a"), F.col("centre_node").alias("b"))
    meeting = placed.select("node", "label", "dim", "copies", "home", "best", "core").join(
        cells.where("touched IS NULL").select("label", "dim", "home", F.lit(True).alias("core")),
        ["label", "dim", "home", "core"], "left_anti")
    shipped = cut_lineage(meeting.join(meeting.groupBy(*place).count().where("count > 1").select(*place), place))
    # as few blocks as keep all cores busy and fit a task
    cores = spark.sparkContext.defaultParallelism
    block = min(max(block_rows, -(-shipped.count() // (4 * cores))), max(1, BLOCK_BYTES // (8 * width)))
    layouts = _layouts(shipped, block)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(spread, min(sum(y.blocks for y in layouts.values()), MOST_TASKS))
    dealt = shipped.drop("best").join(nodes.select("node", "vec"), "node").mapInArrow(_deal(centres, cosine, layouts, tasks), (
        f"task int, label {label}, dim int, block int, visits boolean, node long, core int, copies long, "
        f"vec {nodes.schema['vec'].dataType.simpleString()}"))
    solved = cut_lineage(dealt.repartitionById(tasks, F.col("task")).sortWithinPartitions(
        "label", "dim", "block", "visits").select("label", "dim", "block", "visits", "node", "core", "copies", "vec").mapInArrow(
        _blocks(cosine), _FOUND))
    links = whole.unionByName(solved.where("node IS NOT NULL").select("node", "links"))
    return links, stars.unionByName(solved.where("a IS NOT NULL").select("a", "b"))
