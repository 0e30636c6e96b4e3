"""Set similarity join on word n-grams with signature trees.

Every distinct set of n-grams carries its size and a token bitmap. Sets that reach the threshold must share a token among
the first few of each in one common order; frequent tokens come last in it, so such a block is small unless its texts are
alike as a whole. In a block the sets are the leaves of a signature tree: nodes hold the OR of the bitmaps below them and
the range of sizes. The tree is traversed against itself; a pair of nodes is dropped when sizes cannot fit, when the largest
possible overlap (common bits plus tokens beyond one per bit) is too small, or when all sets below both are known to be
linked. A pair of sets is left to the block of the first token that both share: members know some of the shared tokens before
their block's, and a pair that has one in common is judged there.

Traversals run twice. The first proposes one partner per set and block; verified, these pairs join a group of n near copies by
n links. The second, in blocks that still hold several components, only finds out which sets have any partner left. They meet
again in their block with their exact sets: shared tokens are counted there, and what is linked is joined there by links that
span the block, at most one per set. So no group is expanded into its pairs, whether they are linked or not, and no link
between components is lost. Blocks beyond ``BLOCK_ROWS`` are cut into parts that meet pairwise in different tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.components import components
from fieldpulse.llm.words import mix, sequences, slices, split_words
from fieldpulse.session import cut_lineage

BITS = 1024
WIDE_BITS = 1 << 14
BLOCK_ROWS = 2000
FREQUENT = 48
MOST_FREQUENT = 1 << 16
LEAF = 16
FAN = 8
KNOWN = 4  # shared tokens before the block's that a member carries
NONE = -(1 << 63)
INDEXED = 1 << 21  # entries of the index that a task looks at in one step
_SET = "row long, id long, text_sha binary, n long, digest binary, prefix array<long>, bitmap binary"


def token_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text with fewer words is one sequence, without words nothing."""
    words = split_words(texts, lower=True)
    hashes = words.hashes()
    grams = sequences(hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        else:
            out.append(sequences(hashes[a:b], b - a) if b > a else grams[:0])
    return out


def prefix_size(n: int, percent: int) -> int:
    """So many first tokens of a set of n must hold one of any set that is similar enough."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def bitmap(tokens: np.ndarray, bits: int = BITS) -> bytes:
    flags = np.zeros(bits, bool)
    flags[(mix(tokens.copy()) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _frequent(size: int):
    """Tokens found in several different sets of a task, with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, total = [], set(), 0

        def flush():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(2, len(held) // 1000)
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))],
                                              names=["token", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                for tokens in token_sets(batch.column("text"), size):
                    mark = hash(tokens.tobytes())
                    if len(tokens) and mark not in seen:
                        seen.add(mark)
                        held.append(tokens)
                        total += len(tokens)
                if total > 2_000_000:
                    yield flush()
                    held, seen, total = [], set(), 0
        if held:
            yield flush()
    return run


def _sets(size: int, percent: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, digests, prefixes, bitmaps = [], [], [], []
                for tokens in token_sets(batch.column("text"), size):
                    late = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens \
                        if len(frequent) else np.zeros(len(tokens), bool)
                    order = np.concatenate([tokens[~late], tokens[late]])
                    sizes.append(len(tokens))
                    digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                    prefixes.append(order[:prefix_size(len(tokens), percent)].view(np.int64))
                    bitmaps.append(bitmap(tokens))
                edges = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("id"), batch.column("text_sha"), pa.array(sizes, pa.int64()),
                     pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat, pa.int64())),
                     pa.array(bitmaps, pa.binary())], names=["row", "id", "text_sha", "n", "digest", "prefix", "bitmap"])
    return run


class Leaves:
    """Sets of one block: node numbers, sizes, bitmaps as 64-bit words, components, side (0, 1; 2 meets all), known tokens."""

    def __init__(self, ids, sizes, maps, roots, sides, known=None):
        known = np.full((len(ids), 1), NONE) if known is None else known
        order = np.lexsort((maps[:, 0], sizes))
        self.ids, self.sizes, self.maps = ids[order], sizes[order], maps[order]
        self.roots, self.sides, self.known = roots[order], sides[order], known[order]
        self.extra = self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64)


class Tree:
    """Levels of nodes over leaves in order of size, bottom first. A node covers ``LEAF * FAN ** level`` leaves."""

    def __init__(self, leaves: Leaves):
        self.leaves, self.levels = leaves, []
        n, width = len(leaves.ids), LEAF
        while True:
            cut = np.arange(0, n, width)
            self.levels.append({
                "maps": np.bitwise_or.reduceat(leaves.maps, cut), "low": np.minimum.reduceat(leaves.sizes, cut),
                "high": np.maximum.reduceat(leaves.sizes, cut), "extra": np.maximum.reduceat(leaves.extra, cut),
                "first": np.minimum.reduceat(leaves.roots, cut), "last": np.maximum.reduceat(leaves.roots, cut)})
            if len(cut) == 1:
                break
            width *= FAN

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaf pairs i < j that may reach the threshold and do not lie in one component."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            keep = fits(level["maps"][a], level["maps"][b], level["low"][a], level["high"][a], level["low"][b],
                        level["high"][b], np.minimum(level["extra"][a], level["extra"][b]), percent)
            keep &= ~((level["first"][a] == level["last"][a]) & (level["first"][b] == level["last"][b])
                      & (level["first"][a] == level["first"][b]))
            a, b = a[keep], b[keep]
            below = len(self.levels[depth - 1]["low"]) if depth else len(self.leaves.ids)
            a, b = descend(a, b, FAN if depth else LEAF, below)
        x = self.leaves
        out_a, out_b = [a[:0]], [b[:0]]
        for at in range(0, len(a), 1 << 16):
            i, j = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
            keep = (i < j) & (x.roots[i] != x.roots[j]) & ((x.sides[i] != x.sides[j]) | (x.sides[i] == 2))
            i, j = i[keep], j[keep]
            keep = judged_here(x.known[i], x.known[j])
            i, j = i[keep], j[keep]
            keep = fits(x.maps[i], x.maps[j], x.sizes[i], x.sizes[i], x.sizes[j], x.sizes[j],
                        np.minimum(x.extra[i], x.extra[j]), percent)
            out_a.append(i[keep])
            out_b.append(j[keep])
        return np.concatenate(out_a), np.concatenate(out_b)


def descend(a: np.ndarray, b: np.ndarray, fan: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Children pairs of node pairs; a pair of one node with itself gives each pair of children once."""
    step = np.arange(fan)
    left = (a[:, None, None] * fan + step[None, :, None]).repeat(fan, 2).ravel()
    right = (b[:, None, None] * fan + step[None, None, :]).repeat(fan, 1).ravel()
    keep = (left < below) & (right < below) & (left <= right)
    return left[keep], right[keep]


def judged_here(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two members share no token that comes before their block's (of those they know)."""
    return ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] != NONE)).any(axis=(1, 2))


def fits(maps_a, maps_b, low_a, high_a, low_b, high_b, extra, percent: int) -> np.ndarray:
    """Whether some sets with these bitmaps and sizes can reach the threshold."""
    keep = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    at = np.flatnonzero(keep)
    overlap = np.bitwise_count(maps_a[at] & maps_b[at]).sum(1, dtype=np.int64) + extra[at]
    overlap = np.minimum(overlap, np.minimum(high_a[at], high_b[at]))
    keep[at] = (100 + percent) * overlap >= percent * (low_a[at] + low_b[at])
    return keep


def one_partner(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, for each leaf the first one that it is part of."""
    if not len(a):
        return a, b
    leaf, partner = np.r_[a, b], np.r_[b, a]
    order = np.lexsort((partner, leaf))
    leaf, partner = leaf[order], partner[order]
    new = np.r_[True, leaf[1:] != leaf[:-1]]
    return leaf[new], partner[new]


def leaf_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of many blocks at once, each block so small that its tree is one leaf node."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sizes):
        i, j = np.triu_indices(n, 1)
        begin = starts[sizes == n][:, None]
        out_a.append((begin + i).ravel())
        out_b.append((begin + j).ravel())
    return np.concatenate(out_a), np.concatenate(out_b)


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]):
    """Columns of whole groups (block, part) and the cuts between the groups; batches come sorted by group.

    Fixed-size lists of numbers become matrices.
    """
    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for name in names:
            column = batch.column(name)
            if pa.types.is_binary(column.type):
                out.append(np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(batch.num_rows, -1))
            elif name in ("known", "bitmap"):
                out.append(column.flatten().to_numpy().reshape(batch.num_rows, -1).view(np.uint64 if name == "bitmap" else np.int64))
            elif name == "tokens":
                parts = np.empty(batch.num_rows, object)
                edges = column.offsets.to_numpy() - column.offsets[0].as_py()
                flat = column.flatten().to_numpy()
                parts[:] = [flat[x:y] for x, y in zip(edges, edges[1:])]
                out.append(parts)
            else:
                out.append(column.to_numpy())
        return out

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = columns(batch)
        if held is not None:
            found = [np.concatenate([h, c]) for h, c in zip(held, found)]
        block, part = found[0], found[1]
        cut = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1])])
        if len(cut) > 1:
            yield [c[:cut[-1]] for c in found], cut
        held = [c[cut[-1]:] for c in found]
    if held is not None:
        yield held, np.array([0, len(held[0])])


def _propose(percent: int, single: bool):
    """With ``single`` pairs (a, b), one per set and group; else the members (block, part, node) that have any partner."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(columns, cut):
            blocks, groups, ids, sizes, roots, sides, maps, known = columns
            many = cut[1:] - cut[:-1]
            small = (many > 1) & (many <= LEAF)
            a, b = leaf_pairs(cut[:-1][small], many[small])
            keep = (roots[a] != roots[b]) & ((sides[a] != sides[b]) | (sides[a] == 2))
            a, b = a[keep], b[keep]
            keep = judged_here(known[a], known[b])
            a, b = a[keep], b[keep]
            extra = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
            keep = fits(maps[a], maps[b], sizes[a], sizes[a], sizes[b], sizes[b], np.minimum(extra[a], extra[b]), percent)
            a, b = a[keep], b[keep]
            if single:
                a, b = one_partner(a, b)
                found = [(ids[a], ids[b])]
            else:
                found = [np.unique(np.r_[a, b])]
            for s, e in zip(cut[:-1][many > LEAF].tolist(), cut[1:][many > LEAF].tolist()):
                # rows stand for themselves here, so that proposals name rows
                tree = Tree(Leaves(np.arange(s, e), sizes[s:e], maps[s:e], roots[s:e], sides[s:e], known[s:e]))
                a, b = tree.pairs(percent)
                if single:
                    a, b = one_partner(a, b)
                    found.append((ids[tree.leaves.ids[a]], ids[tree.leaves.ids[b]]))
                else:
                    found.append(tree.leaves.ids[np.unique(np.r_[a, b])])
            if single:
                return pairs_batch(found)
            rows = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(blocks[rows]), pa.array(groups[rows]), pa.array(ids[rows])],
                                              names=["block", "part", "node"])

        for columns, cut in _grouped(batches, ["block", "part", "node", "n", "root", "side", "bitmap", "known"]):
            yield solve(columns, cut)
    return run


def exact_links(tokens: list[np.ndarray], roots: np.ndarray, sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows that join what the sets link, at most one less than rows; rows with equal roots are joined already.

    Shared tokens are counted by an index from token to rows, row by row, so that every overlap is exact.
    """
    n = len(tokens)
    sizes = np.array(list(map(len, tokens)))
    flat, row = np.concatenate(tokens), np.repeat(np.arange(n), sizes)
    _, flat = np.unique(flat, return_inverse=True)
    order = np.argsort(flat, kind="stable")
    holders = row[order]
    begin = np.searchsorted(flat[order], np.arange(flat.max() + 2 if len(flat) else 1))
    edges = np.cumsum(np.r_[0, sizes])
    _, group = np.unique(roots, return_inverse=True)
    found = []
    for i in range(n - 1):
        if (group == group[0]).all():
            break
        mine = flat[edges[i]:edges[i + 1]]
        low, many = begin[mine], begin[mine + 1] - begin[mine]
        shared, steps = np.zeros(n, np.int64), np.cumsum(many) // INDEXED
        for step in np.unique(steps):
            a, m = low[steps == step], many[steps == step]
            shared += np.bincount(holders[np.repeat(a - np.cumsum(m) + m, m) + np.arange(m.sum())], minlength=n)
        linked = (100 + percent) * shared >= percent * (sizes + sizes[i])
        linked[:i + 1] = False
        linked &= (group != group[i]) & ((sides != sides[i]) | (sides == 2))
        partners = np.flatnonzero(linked)
        labels, one = np.unique(group[partners], return_index=True)
        found += [(i, int(j)) for j in partners[one]]
        if len(labels):
            group[np.isin(group, labels)] = group[i]
    return found


def _settle(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, cut in _grouped(batches, ["block", "part", "node", "root", "side", "tokens"]):
            _, _, ids, roots, sides, tokens = columns
            found = []
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
                if e - s > 1:
                    found += [(s + i, s + j) for i, j in exact_links(list(tokens[s:e]), roots[s:e], sides[s:e], percent)]
            a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            yield pairs_batch([(ids[a], ids[b])])
    return run


def pairs_batch(found) -> pa.RecordBatch:
    a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def dealt(members: DataFrame, single: bool, block_rows: int) -> DataFrame:
    """Members (block, node, n, root, bitmap, known), each block counted in ``rows``, with part and side.

    Larger blocks are cut by component, components larger than a part once more by set, and the parts meet pairwise, but
    not those of one component. With ``single`` only the parts themselves are searched.
    """
    usual = members.where(F.col("rows") <= block_rows).withColumn("part", F.lit(0)).withColumn("side", F.lit(2))
    large = members.where(F.col("rows") > block_rows)
    parts = F.ceil(2 * F.col("rows") / block_rows).cast("int")
    if single:
        large = large.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int") + 1).withColumn("side", F.lit(2))
    else:
        sizes = large.groupBy("block", "root").agg(F.count("*").alias("own"))
        large = large.join(sizes, ["block", "root"])
        slice_ = F.when(F.col("own") > block_rows // 2, F.xxhash64("node")).otherwise(F.lit(0))
        large = large.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("root", slice_), parts).cast("int"))
        large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        large = large.withColumn("part", low * F.col("parts") + high + 1).withColumn(
            "side", F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1))
    columns = ["block", "part", "node", "n", "root", "side", "bitmap", "known"]
    return usual.select(*columns).unionByName(large.select(*columns))


def by_group(members: DataFrame) -> DataFrame:
    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(width, "block", "part").sortWithinPartitions("block", "part")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold: wide bitmaps first, then the sets of what is left."""
    def beside(found: DataFrame, *columns: str) -> DataFrame:
        for node, mark in (("a", "x"), ("b", "y")):
            found = found.join(sets.select(F.col("node").alias(node), *[F.col(c).alias(f"{mark}_{c}") for c in columns]), node)
        return found

    def reach(overlap: Column) -> Column:
        return (100 + percent) * overlap >= percent * (F.col("x_n") + F.col("y_n"))

    bits = F.aggregate(F.zip_with("x_wide", "y_wide", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda t, v: t + v)
    near = cut_lineage(beside(pairs, "n", "extra", "wide").where(reach(bits + F.least("x_extra", "y_extra"))).select("a", "b"))
    involved = cut_lineage(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    sets = sets.join(involved, "node", "left_semi")
    return beside(near, "n", "tokens").where(reach(F.size(F.array_intersect("x_tokens", "y_tokens")))).select("a", "b")


def _tokens(size: int):
    """Exact sets with a bitmap wide enough for long texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = token_sets(batch.column("text"), size)
                edges = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                maps = [np.frombuffer(bitmap(tokens, WIDE_BITS), np.int64) for tokens in sets]
                words = np.arange(len(sets) + 1, dtype=np.int32) * (WIDE_BITS // 64)
                extra = [len(t) - int(np.bitwise_count(m.view(np.uint64)).sum()) for t, m in zip(sets, maps)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array(list(map(len, sets)), pa.int64()), pa.array(extra, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(words), pa.array(np.concatenate(maps) if maps else flat.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.view(np.int64)))],
                    names=["node", "n", "extra", "wide", "tokens"])
    return run


def exact_sets(active: DataFrame, nodes: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Sets of the active nodes, made again from their texts."""
    wanted = nodes.join(active, "node", "left_semi").select("node", F.col("id").alias("i"), F.col("text_sha").alias("s"))
    texts = rows.select("id", "text_sha", "text").join(
        wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_sha") == F.col("s"))).select("node", "text")
    return cut_lineage(texts.dropDuplicates(["node"]).mapInArrow(
        _tokens(size), "node long, n long, extra long, wide array<long>, tokens array<long>"))


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
                       block_rows: int = BLOCK_ROWS, frequent_from: int = FREQUENT) -> DataFrame:
    """One row per input row: key, n_shingles, component_id and text_sha (of the text, null as empty).

    A-Z count as a-z. Sets link when 100 * intersection >= percent * union; component_id is the smallest key that links
    reach. Texts without words, or null, link with nothing and are their own component. Texts with equal sets are one node,
    so copies are never paired. A null key is reached and linked like any other but never names a component that has another
    key. Repeated rows share their component; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"),
                       F.col(text).alias("text")).withColumn("text_sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    counted = rows.select("text").mapInArrow(_frequent(size), "token long, n long").groupBy("token").agg(
        F.sum("n").alias("n")).where(F.col("n") >= frequent_from).orderBy(F.col("n").desc(), "token").limit(MOST_FREQUENT)
    frequent = np.sort(np.array([r[0] for r in counted.select("token").collect()], np.int64).view(np.uint64))
    records = cut_lineage(rows.mapInArrow(_sets(size, percent, frequent), _SET))
    # one node per distinct set: its smallest row stands for it
    one = F.min_by(F.struct("row", "n", "prefix", "bitmap", "id", "text_sha"), F.col("row")).alias("one")
    nodes = cut_lineage(records.where("n > 0").groupBy("digest").agg(one, F.min("id").alias("low_id")).select(
        "digest", "low_id", F.col("one.row").alias("node"), "one.n", "one.prefix", "one.bitmap", "one.id", "one.text_sha"))
    firsts = nodes.select("digest", "node", "low_id")
    links = _links(nodes, rows, size, percent, block_rows)
    if links is None:
        roots = firsts.select("digest", F.col("low_id").alias("component"))
    else:
        found = components(links)
        named = firsts.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = cut_lineage(named)
        lowest = named.groupBy("root").agg(F.min("low_id").alias("component"))
        roots = named.join(lowest, "root").select("digest", "component")
    return records.join(roots, "digest", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"), "text_sha")


def _postings(nodes: DataFrame) -> DataFrame:
    """Members of every block of two or more: node, block, rows of the block, and known tokens before the block's."""
    spread = nodes.select("node", F.posexplode("prefix").alias("at", "block"))
    shared = cut_lineage(spread.groupBy("block").agg(F.count("*").alias("rows")).where("rows > 1"))
    ordered = spread.join(shared, "block").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "block", "rows"))).alias("l"))
    first = F.transform(F.slice("l", 1, KNOWN), lambda x: x["block"])
    each = ordered.select("node", first.alias("first"), F.posexplode("l").alias("k", "m"))
    before = F.slice("first", F.lit(1), F.least("k", F.lit(KNOWN)))
    known = F.slice(F.concat(before, F.array_repeat(F.lit(NONE), KNOWN)), 1, KNOWN)
    return cut_lineage(each.select("node", "m.block", "m.rows", known.alias("known")))


def _links(nodes: DataFrame, rows: DataFrame, size: int, percent: int, block_rows: int) -> DataFrame | None:
    """Verified links that join every component; None if no pair was proposed."""
    postings = _postings(nodes)
    light = nodes.select("node", "n", "bitmap")
    members = postings.join(light, "node").withColumn("root", F.col("node"))
    seeds = cut_lineage(by_group(dealt(members, True, block_rows)).mapInArrow(
        _propose(percent, True), "a long, b long").distinct())
    active = seeds.select(F.col("a").alias("node")).union(seeds.select("b")).union(
        postings.where(F.col("rows") > block_rows).select("node")).distinct()
    active = cut_lineage(active)
    if active.isEmpty():
        return None
    sets = exact_sets(active, nodes, rows, size)
    first = cut_lineage(verified(seeds, sets, percent))
    roots = components(first)
    # what is left: pairs in different components, among sets that have any partner
    known = light.join(active, "node", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    again = cut_lineage(postings.join(known, "node"))
    mixed = cut_lineage(again.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
        "low < high").select("block"))
    meeting = cut_lineage(dealt(again.join(mixed, "block"), False, block_rows))
    group = ["block", "part", "node"]

    def suspects(members: DataFrame) -> DataFrame:
        return cut_lineage(by_group(members).mapInArrow(_propose(percent, False), "block long, part int, node long"))

    # long texts fill a small bitmap: who is left meets again with a wide one, and only then with whole sets
    few = suspects(meeting).join(meeting.drop("bitmap"), group).join(
        sets.select("node", F.col("wide").alias("bitmap")), "node")
    there = suspects(few).join(meeting.select(*group, "root", "side"), group)
    second = by_group(there.join(sets.select("node", "tokens"), "node")).mapInArrow(_settle(percent), "a long, b long")
    return first.unionByName(cut_lineage(second))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest key, with all columns.

    Rows that repeat key and text of the row that stays are not told apart from it; of a component without any key all stay.
    """
    kept = similar_components(docs, key, text, size, percent).where(F.col(key).eqNullSafe(F.col("component_id"))).select(
        F.col(key).alias("__id"), F.col("text_sha").alias("__sha"))
    same = F.col(key).eqNullSafe(F.col("__id")) & (F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)) == F.col("__sha"))
    return docs.join(kept, same, "left_semi")
