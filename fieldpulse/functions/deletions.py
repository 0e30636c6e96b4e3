"""Meetings of short texts by what is left of them after deletions: equal rests have equal marks.

Texts of one length form a matrix of code points. The mark of a rest is a polynomial of its letters, put together from one table
per deletion, so that all rests of a batch cost a few vector additions. Different rests may share a mark by chance; whoever
meets by marks is measured afterwards.

Marks are many times the texts, so they are neither shuffled nor written as they are. The side with fewer marks sets bits of a
filter of bounded size; the other side is read past it, and what passes is written. A second filter, of what passed, leaves of
the first side what may have a partner, and only these few meet in a join. More marks than a filter holds go part by part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.session import cut_lineage

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
UNBASE = pow(BASE, -1, 1 << 64)
ROWS = 1 << 16  # marks made at a time
PROBES = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)  # a bit of a mark each
LEAST_BITS = 12  # of a filter's part, as a power of two
MARK_BITS = 24  # bits of a filter to a mark, at least
PART_BITS = 26  # of the part of a filter that one task makes, as a power of two
MOST_MARKS = (1 << 30) // MARK_BITS  # that a filter holds; it takes 128 MB then
PIECE = 1 << 22  # bytes of a filter in a row


@dataclass(frozen=True)
class Kind:
    """Texts of this length, rid of exactly ``cut`` letters; the number is that of the pair of lengths."""

    number: int
    length: int
    cut: int

    @property
    def rests(self) -> int:
        return math.comb(self.length, self.cut)


@lru_cache(maxsize=64)
def _choices(length: int, cut: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... deletions: which choice of one deletion less each choice goes on from, and the letter that it adds."""
    found, before = [], {(): 0}
    for k in range(1, cut + 1):
        gone = list(combinations(range(length - cut + k), k))
        found.append((np.array([before[g[:-1]] for g in gone], np.int64), np.array([g[-1] for g in gone], np.int64)))
        before = {g: i for i, g in enumerate(gone)}
    return found


def _marks(codes: np.ndarray, kind: Kind) -> np.ndarray:
    """Marks of all rests, a column per text and a row per choice of letters to delete."""
    n, m = codes.shape
    powers = np.array([pow(BASE, i, 1 << 64) for i in range(m)], np.uint64)
    sums = np.zeros((m + 1, n), np.uint64)
    np.cumsum((codes.astype(np.uint64).T + np.uint64(1)) * powers[:, None], axis=0, out=sums[1:])
    # letters after so many deletions stand so many places further left
    out = (sums[m] * np.uint64(pow(UNBASE, kind.cut, 1 << 64)))[None, :]
    out = out ^ np.uint64(0) if not kind.cut else out
    for k, (before, letter) in enumerate(_choices(m, kind.cut)):
        step = sums[:m] * np.uint64(pow(UNBASE, k, 1 << 64)) - sums[1:] * np.uint64(pow(UNBASE, k + 1, 1 << 64))
        out = out[before] + step[letter]
    out ^= np.uint64((kind.number + 1) * UNBASE % (1 << 64))
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(odd)
    out ^= out >> np.uint64(31)
    return out.view(np.int64)


def rest_marks(codes: np.ndarray, kind: Kind) -> np.ndarray:
    """Marks of all rests, a row per text and a column per choice of letters to delete."""
    return _marks(codes, kind).T


def letters(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, numbers of the texts of this length, their code points as rows)."""
    texts = texts.cast(pa.large_string())
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    plain = int(pc.sum(pc.binary_length(texts)).as_py() or 0) == int(lengths.sum())  # a byte a letter
    if plain:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        if plain:
            codes = data[offsets[at][:, None] + np.arange(length)] if length else np.zeros((len(at), 0), np.uint8)
        else:
            whole = "".join(texts.take(pa.array(at)).to_pylist()).encode("utf-32-le")
            codes = np.frombuffer(whole, np.uint32).reshape(len(at), length)
        yield length, at, codes


def _each(texts: pa.Array, kinds: list[Kind]) -> Iterator[tuple[Kind, np.ndarray, np.ndarray]]:
    """(kind, numbers of texts, marks with a column per text), a bounded number of marks at a time."""
    by_length: dict[int, list[Kind]] = {}
    for kind in kinds:
        by_length.setdefault(kind.length, []).append(kind)
    for length, at, codes in letters(texts):
        for kind in by_length.get(length, ()):
            step = max(1, ROWS // kind.rests)
            for first in range(0, len(at), step):
                yield kind, at[first:first + step], _marks(codes[first:first + step], kind)


@dataclass(frozen=True)
class Filter:
    """Where the bits of every number's marks lie: first bit and size as a power of two. All bits of a mark are in one part."""

    places: dict[int, tuple[int, int]]

    @staticmethod
    def of(marks: dict[int, int]) -> Filter:
        """Room for so many marks of every number; the larger come first, so that none but the largest reach into two parts."""
        sizes = {number: max(LEAST_BITS, math.ceil(math.log2(max(1, MARK_BITS * n)))) for number, n in marks.items()}
        places, at = {}, 0
        for number in sorted(sizes, key=lambda k: -sizes[k]):
            places[number] = (at, sizes[number])
            at += 1 << sizes[number]
        return Filter(places)

    @property
    def bits(self) -> int:
        return sum(1 << size for _, size in self.places.values())

    @property
    def parts(self) -> int:
        return -(-self.bits >> PART_BITS)

    def parts_of(self, number: int, marks: np.ndarray) -> np.ndarray | int:
        """The part of every mark, or of all of them."""
        at, size = self.places[number]
        if size <= PART_BITS:
            return at >> PART_BITS
        return (marks.view(np.uint64) >> np.uint64(64 - (size - PART_BITS))).view(np.int64) + (at >> PART_BITS)

    def probe(self, number: int, marks: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte and bit in it."""
        at, size = self.places[number]
        mixed = marks.view(np.uint64) * np.uint64(PROBES[turn])
        byte = (mixed >> np.uint64(64 + 3 - min(size, PART_BITS))).view(np.int64)
        if size > PART_BITS:
            byte += self.parts_of(number, marks) << (PART_BITS - 3)
        else:
            byte += at >> 3
        return byte, (mixed >> np.uint64(32)).view(np.uint8)[::8] & np.uint8(7)

    def passing(self, bits: np.ndarray, number: int, marks: np.ndarray) -> np.ndarray:
        """Numbers of the marks all of whose bits are set."""
        kept = None
        for turn in range(len(PROBES)):
            byte, bit = self.probe(number, marks if kept is None else marks[kept], turn)
            hit = np.flatnonzero((bits.take(byte) >> bit) & np.uint8(1))
            kept = hit if kept is None else kept[hit]
            if not len(kept):
                break
        return kept


def _setting(layout: Filter, source):
    """Rows (at, bits) of the filter's part; ``source(batch, numbers)`` gives (number, marks) of these numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, part = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if flags is None:  # a task makes one part
                part = batch.column("part")[0].as_py()
                flags = np.zeros(-(-min(layout.bits - (part << PART_BITS), 1 << PART_BITS) // 8) * 8, np.uint8)
                numbers = {k for k, (at, size) in layout.places.items()
                           if at >> PART_BITS <= part <= at + (1 << size) - 1 >> PART_BITS}
            for number, marks in source(batch, numbers):
                here = layout.parts_of(number, marks)
                marks = marks[here == part] if isinstance(here, np.ndarray) else marks
                for turn in range(len(PROBES)):
                    byte, bit = layout.probe(number, marks, turn)
                    flags[(byte - (part << (PART_BITS - 3))) * 8 + bit] = 1
        if flags is not None:
            bits = np.packbits(flags, bitorder="little")
            for at in range(0, len(bits), PIECE):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << (PART_BITS - 3)) + at], pa.int64()), pa.array([bits[at:at + PIECE].tobytes()], pa.binary())],
                    names=["at", "bits"])
    return run


def _filter(rows: DataFrame, layout: Filter, source):
    """The filter's bits, sent to all machines; every part is made by one task that reads all rows."""
    each = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(layout.parts - 1)))).repartitionById(
        layout.parts, F.col("part"))
    bits = bytearray(-(-layout.bits // 8))
    for row in each.mapInArrow(_setting(layout, source), "at long, bits binary").collect():
        bits[row["at"]:row["at"] + len(row["bits"])] = row["bits"]
    return rows.sparkSession.sparkContext.broadcast(bytes(bits))


def _passing(kinds: list[Kind], layout: Filter, sent):
    """(text, number, mark) of the marks that pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            text = batch.column("text")
            for kind, at, marks in _each(text, kinds):
                flat = marks.ravel()
                kept = layout.passing(bits, kind.number, flat)
                if len(kept):
                    yield pa.RecordBatch.from_arrays(
                        [text.take(pa.array(at[kept % len(at)])), pa.array(np.full(len(kept), kind.number, np.int32)),
                         pa.array(flat[kept])], names=["text", "number", "mark"])
    return run


def _meet_part(few: DataFrame, many: DataFrame, mine: list[Kind], theirs: list[Kind], marks: dict[int, int]) -> DataFrame:
    """(few, many): distinct pairs of texts that share a mark, read by two filters."""
    def made(batch: pa.RecordBatch, numbers: set[int]):
        for kind, _, found in _each(batch.column("text"), [k for k in mine if k.number in numbers]):
            yield kind.number, found.ravel()

    def written(batch: pa.RecordBatch, numbers: set[int]):
        number, mark = batch.column("number").to_numpy(), batch.column("mark").to_numpy()
        for k in numbers.intersection(np.unique(number).tolist()):
            yield k, mark[number == k]

    schema = "text string, number int, mark long"
    layout = Filter.of(marks)
    sent = _filter(few, layout, made)
    passed = cut_lineage(many.mapInArrow(_passing(theirs, layout, sent), schema))
    sent.destroy()
    counts = {r["number"]: r["count"] for r in passed.groupBy("number").count().collect()}
    if not counts:
        return few.sparkSession.createDataFrame([], "few string, many string")
    # no larger than the first filter, should very many marks be shared
    layout = Filter.of({k: min(n, max(1, MOST_MARKS // len(counts))) for k, n in counts.items()})
    sent = _filter(passed.select("number", "mark"), layout, written)
    offered = cut_lineage(few.mapInArrow(_passing([k for k in mine if k.number in counts], layout, sent), schema))
    sent.destroy()
    spread = int(few.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return offered.select(F.col("text").alias("few"), "number", "mark").hint("merge").join(
        passed.select(F.col("text").alias("many"), "number", "mark"), ["number", "mark"]).select("few", "many").repartition(
        spread, "few", "many").distinct()  # by number: few bytes, but every pair is measured


def _dealt(df: DataFrame) -> DataFrame:
    """Distinct texts of every wanted length, written once in as many files as a shuffle is wide: every pass reads them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.toDF("text").repartition(parts, "text").distinct())


def meetings(queries: DataFrame, names: DataFrame, kinds: list[tuple[Kind, Kind]], most_marks: int = MOST_MARKS) -> Iterator[DataFrame]:
    """(query, name) pairs that share a rest of a pair of kinds, in parts without common pairs; a kind's number is its own.

    Of every pair of kinds the side with fewer marks makes the filter; sides with more than ``most_marks`` go in parts.
    """
    sides = {}
    for side, df in enumerate((queries, names)):
        lengths = sorted({pair[side].length for pair in kinds})
        sides[side] = _dealt(df.where(F.length(df.columns[0]).isin(lengths))) if lengths else None
    if not kinds:
        return
    counts = [{r["n"]: r["count"] for r in df.groupBy(F.length("text").alias("n")).count().collect()} for df in sides.values()]
    units: list[tuple[int, int, list[tuple[Kind, Kind]], dict[int, int]]] = []  # side with fewer marks, parts, kinds, marks
    for pair in kinds:
        marks = [counts[side].get(kind.length, 0) * kind.rests for side, kind in enumerate(pair)]
        if not min(marks):
            continue
        side = int(marks[1] < marks[0])
        parts = -(-marks[side] // most_marks)
        open_unit = next((u for u in units if u[0] == side and u[1] == parts == 1 and sum(u[3].values()) + marks[side] <= most_marks), None)
        if open_unit is None:
            units.append(open_unit := (side, parts, [], {}))
        open_unit[2].append(pair)
        open_unit[3][pair[0].number] = -(-marks[side] // parts)
    for side, parts, pairs, marks in units:
        mine, theirs = [p[side] for p in pairs], [p[1 - side] for p in pairs]
        few, many = (sides[s].where(F.length("text").isin(sorted({k.length for k in some})))
                     for s, some in ((side, mine), (1 - side, theirs)))
        for part in range(parts):
            some = few if parts == 1 else few.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(parts)) == part)
            met = _meet_part(some, many, mine, theirs, marks)
            yield met.toDF("query", "name") if side == 0 else met.select(F.col("many").alias("query"), F.col("few").alias("name"))
