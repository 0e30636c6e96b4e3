"""Repeated passages by prefix-partitioned suffix trees.

A suffix starts at every word and matters up to the length of a window (50 words). Suffixes are dealt to groups by a prefix
of their content that two equal windows share: the run of eight words with the smallest hash inside the window (its anchor).
Anchors that occur in one text only end there, so most suffixes never leave their task. A group holds the words around the
occurrences of one anchor; its suffixes are sorted, and neighbours that agree over a whole window form a deep internal node
of the subtree, that is a repeat. Of each node the smallest document keeps the words; nodes next to each other make the
maximal repeats. Anchors with more occurrences than a group may hold are searched in parts: a part settles its own nodes and
sends one leaf of each node, that of its smallest document, on to groups of the longest prefix, the whole window, where a
group is a single node and its smallest document an aggregate that starts in every task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.words import sequences, slices, split_words
from fieldpulse.session import cut_lineage

WINDOW = 50
ANCHOR = 8
GROUP_ROWS = 4000
NO_ID = (1 << 63) - 1  # stands for a null key: larger than all others
_RECORD = ("row long, id long, text_sha string, n_words long, digest binary, "
           "anchors array<struct<key:long,first:int,last:int>>")
_ANCHORS = pa.list_(pa.struct([("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))


def window_anchors(hashes: np.ndarray, edges: np.ndarray, window: int, anchor: int):
    """Key, first and last window start, and text number of each stretch of windows that share an anchor occurrence."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none
    grams = sequences(hashes, anchor)
    low = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)  # of equals the leftmost
    width, have = window - anchor + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[:len(low) - (width - have)], low[width - have:])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(at))
    text = np.searchsorted(edges, starts, "right") - 1
    valid = starts + window <= edges[text + 1]
    joined = valid[1:] & valid[:-1] & (at[1:] == at[:-1])
    first = np.flatnonzero(valid & ~np.r_[False, joined])
    last = np.flatnonzero(valid & ~np.r_[joined, False])
    return grams[at[first]].view(np.int64), first, last, text[first]


def _records(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = split_words(batch.column("text"))
                keys, first, last, text = window_anchors(words.hashes(), words.first, window, anchor)
                begin = words.first[text]
                edges = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
                flat = pa.StructArray.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array((first - begin).astype(np.int32)),
                     pa.array((last - begin).astype(np.int32))], names=["key", "first", "last"])
                digests = [hashlib.sha256(b" ".join((t.as_py() or "").encode().split())).digest()
                           for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("id"), batch.column("text_sha"),
                     pa.array(np.diff(words.first), pa.int64()), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(edges), flat)],
                    names=["row", "id", "text_sha", "n_words", "digest", "anchors"])
    return run


def _contexts(window: int):
    """Words around each anchor occurrence, and the part of the group that it goes to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for row, key_id, text, anchors in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(),
                                                  batch.column("text"), batch.column("anchors")):
                words = text.as_py().encode().split()
                for a in anchors.as_py():
                    part = zlib.crc32(row.to_bytes(8)) % a["parts"]
                    context = b" ".join(words[a["first"]:a["last"] + window])
                    for column, value in zip(out, (a["key"], part, a["parts"], row, key_id, a["first"], context)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                             names=["key", "part", "parts", "row", "id", "first", "words"])
    return run


_CONTEXT = "key long, part int, parts int, row long, id long, first int, words binary"


def suffixes(words: bytes, window: int) -> list[bytes]:
    """The words of each window start, cut at the window's length."""
    parts = words.split(b" ")
    edges = np.cumsum([0, *(len(p) + 1 for p in parts)]).tolist()
    return [words[edges[k]:edges[k + window] - 1] for k in range(len(parts) - window + 1)]


def stretches(starts: list[int], window: int) -> Iterator[tuple[int, int]]:
    """Maximal ranges of words covered by windows at these starts."""
    begin = end = None
    for s in sorted(starts):
        if end is not None and s <= end:
            end = s + window
        else:
            if end is not None:
                yield begin, end
            begin, end = s, s + window
    if end is not None:
        yield begin, end


def subtree(group: list[tuple[int, int, int, bytes]], window: int):
    """Repeats and smallest leaves of one subtree; ``group`` holds (row, id, first, words).

    The first result are (row, from, to) of words in windows whose node also holds a smaller id, the second one leaf
    (window, id, row, start) of the smallest id for each node.
    """
    leaves = sorted((suffix, key_id, row, first + k) for row, key_id, first, words in group
                    for k, suffix in enumerate(suffixes(words, window)))
    found: dict[int, list[int]] = {}
    smallest = []
    for _, node in groupby(leaves, key=lambda x: x[0]):
        first = next(node)  # by id within the node
        smallest.append(first)
        for _, key_id, row, start in node:
            if key_id > first[1]:
                found.setdefault(row, []).append(start)
            else:
                smallest.append((first[0], key_id, row, start))
    return [(row, a, b) for row, starts in found.items() for a, b in stretches(starts, window)], smallest


def _subtrees(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(groups):
            out = []
            for parts, group in groups:
                repeats, smallest = subtree(group, window)
                out += [(row, a, b, None, None) for row, a, b in repeats]
                if parts > 1:
                    out += [(row, start, start + window, hashlib.blake2b(leaf, digest_size=16).digest(), key_id)
                            for leaf, key_id, row, start in smallest]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=["row", "from", "to", "node", "id"])

        held, place = [], None
        for batch in batches:
            done = []
            for key, part, parts, *rest in zip(*(batch.column(c).to_pylist() for c in (
                    "key", "part", "parts", "row", "id", "first", "words"))):
                if (key, part, parts) != place and held:
                    done.append((place[2], held))
                    held = []
                place = (key, part, parts)
                held.append(tuple(rest))
            yield solved(done)
        if held:
            yield solved([(place[2], held)])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, kept = [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
            words = text.as_py().encode().split()
            gone = np.zeros(len(words), bool)
            for r in ranges:
                gone[r["from"]:r["to"]] = True
            removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                         names=["row", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
                   group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per input row: key, n_words, n_removed, kept (words joined by one space; null if none goes), kept_sha256.

    A word goes if a window that covers it also starts in a document with a smaller key, judged on the input. A null key is
    larger than all others; equal keys are not smaller, so repeated rows are treated alike. Null counts as empty; texts
    shorter than a window keep everything; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_sha", F.sha2("text", 256))
    records = cut_lineage(rows.mapInArrow(_records(window, anchor), _RECORD))
    # texts with the same words: all but the smallest key lose everything, so only the smallest is searched
    firsts = records.where(F.col("n_words") >= window).groupBy("digest").agg(
        F.min(F.struct("id", "row")).alias("one")).select("digest", F.col("one.id").alias("first_id"), F.col("one.row").alias("row"))
    alone = records.where(F.col("n_words") >= window).select("row", "id", "text_sha", "anchors").join(
        firsts.select("row"), "row", "left_semi")
    alone = cut_lineage(alone)
    anchors = alone.select("row", F.explode("anchors").alias("a")).select("row", "a.key", "a.first", "a.last")
    shared = cut_lineage(anchors.groupBy("key").agg(
        F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n")).where("low < high").select(
        "key", F.ceil(F.col("n") / group_rows).cast("int").alias("parts")))
    suspects = anchors.join(shared, "key").groupBy("row").agg(
        F.collect_list(F.struct("key", "first", "last", "parts")).alias("anchors"))
    wanted = suspects.join(alone.select("row", "id", "text_sha"), "row")
    found = cut_lineage(wanted.join(
        rows.select(F.col("id").alias("i"), F.col("text_sha").alias("s"), "text"),
        (F.col("id") == F.col("i")) & (F.col("text_sha") == F.col("s"))).select("row", "id", "text", "anchors"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solved = cut_lineage(found.mapInArrow(_contexts(window), _CONTEXT).repartition(width, "key", "part").sortWithinPartitions(
        "key", "part").mapInArrow(_subtrees(window), "row long, from int, to int, node binary, id long"))
    smallest = solved.where("node IS NOT NULL")
    nodes = cut_lineage(smallest.groupBy("node").agg(F.min("id").alias("low"), F.max("id").alias("high")).where(
        "low < high").select("node", "low"))
    repeats = solved.where("node IS NULL").select("row", "from", "to").unionByName(
        smallest.join(nodes, "node").where("id > low").select("row", "from", "to"))
    ranges = repeats.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    cut = found.dropDuplicates(["row"]).join(ranges, "row").select("row", "text", "ranges").mapInArrow(
        _cut, "row long, n_removed long, kept string")
    # a text repeated under its smallest key shares what was found for the searched row
    judged = records.select("row", "id", "n_words", "digest").join(
        firsts.select("digest", "first_id", F.col("row").alias("first_row")), "digest", "left").withColumn(
        "copy", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)))
    judged = judged.withColumn("look", F.when(F.col("copy"), -F.col("row") - 1).otherwise(F.col("first_row"))).join(
        cut.withColumnRenamed("row", "look"), "look", "left")
    kept = F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept"))
    return judged.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(key), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        kept.alias("kept"), F.coalesce(F.sha2(kept, 256), F.lower(F.hex("digest"))).alias("kept_sha256"))
