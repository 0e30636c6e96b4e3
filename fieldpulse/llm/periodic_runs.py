"""Periodic runs in word sequences by seed and extension on diagonals.

A run of smallest period q has at least max(6, 4q) words, so its first words return q words later as a gram of guaranteed
length: five words for q = 1, and 3 * 2^j words for q from 2^j to 2^(j+1) - 1. Level j indexes the grams of that length and
enumerates the pairs of occurrences in the same text whose lag belongs to the level.

Two facts keep the pairs in proportion to the words. A gram that returns within fewer than 2^j words has a smaller period,
and so has every run of the level that holds it (two periods whose sum does not exceed the gram's length have their greatest
common divisor as a period), so such grams are left to the lower levels; the occurrences of all others lie at least 2^j words
apart, and of them only neighbours can have a lag of the level. And a gram returns only where its beginning does, so a level
looks at what was repeated on the level before.

A pair is extended to both sides while the words q apart are equal. A table holds the furthest word covered per lag: a pair
inside it is not extended again.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldpulse.llm.words import mix, sequences, slices, split_words

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_RUN = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
_RUNS = pa.list_(pa.struct(_RUN))
_SQL_RUN = "struct<start:long,length:long,period:long>"


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal, compared in steps that double."""
    n, step, limit = 0, 16, min(len(a), len(b))
    while n < limit:
        other = np.flatnonzero(a[n:min(n + step, limit)] != b[n:min(n + step, limit)])
        if len(other):
            return n + int(other[0])
        n, step = n + step, 2 * step
    return limit


def _seeds(keys: np.ndarray, at: np.ndarray, width: int):
    """First positions and lags of neighbouring occurrences with a lag in [width, 2 * width), and all repeated positions."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    same, gap = keys[1:] == keys[:-1], at[1:] - at[:-1]
    group = np.cumsum(np.r_[0, ~same])
    dense = np.zeros(len(at), bool)  # grams with a smaller period
    dense[group[1:][same & (gap < width)]] = True
    wanted = same & (gap >= width) & (gap < 2 * width) & ~dense[group[1:]]
    repeated = np.r_[same, False] | np.r_[False, same]
    return at[:-1][wanted], gap[wanted], np.sort(at[repeated])


def find_runs(hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of every run, by text, start and period.

    ``hashes`` are the words of some texts one after the other, ``first`` the first word of each text (one more at the end).
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    size = np.diff(first)[text]
    found: dict[tuple[int, int, int], int] = {}
    powers = {0: hashes}  # hashes of 2^m words
    at, level = np.arange(len(hashes)), 0
    while True:
        width = 1 << level
        length = 5 if level == 0 else 3 * width
        at = at[(at + length <= end[at]) & (size[at] >= max(LEAST_LENGTH, LEAST_EXPONENT * width))]
        if not len(at):
            break
        if level == 0:
            grams = sequences(hashes, length)[at]
        else:
            for m in (level, level + 1):
                if m not in powers:
                    half = powers[m - 1]
                    step = 1 << (m - 1)
                    powers[m] = mix(half[:max(len(half) - step, 0)] * _SPREAD + half[step:])
            powers.pop(level - 1, None)
            grams = mix(powers[level + 1][at] * _SPREAD + powers[level][at + 2 * width])
        keys = mix(grams ^ mix(text[at].astype(np.uint64) * _SPREAD + np.uint64(1)))
        seeds, lags, at = _seeds(keys, at, width)
        order = np.lexsort((seeds, lags))
        seeds, lags = seeds[order], lags[order]
        follows = np.r_[False, (seeds[1:] == seeds[:-1] + 1) & (lags[1:] == lags[:-1])] if len(seeds) else np.zeros(0, bool)
        covered: dict[int, int] = {}  # lag: end of the furthest match on its diagonal
        for seed, lag in zip(seeds[~follows].tolist(), lags[~follows].tolist()):
            if seed < covered.get(lag, 0):
                continue
            n = int(text[seed])
            low, high = int(first[n]), int(first[n + 1])
            right = agreement(hashes[seed:high - lag], hashes[seed + lag:high])
            left = agreement(hashes[low:seed][::-1], hashes[low + lag:seed + lag][::-1])
            covered[lag] = seed + right
            start, matched = seed - left, left + right
            if matched + lag >= max(LEAST_LENGTH, LEAST_EXPONENT * lag):
                found.setdefault((n, start - low, matched + lag), lag)  # lags only grow: the smallest period stays
        level += 1
    return sorted((n, start, length, period) for (n, start, length), period in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; of equals the first, then the one of the smaller period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period:start + length] = True
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def _search(key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                words = split_words(batch.column(text))
                by_text: dict[int, list[tuple[int, int, int]]] = {}
                for n, *one in find_runs(words.hashes(), words.first):
                    by_text.setdefault(n, []).append(tuple(one))
                runs = [by_text.get(n, []) for n in range(batch.num_rows)]
                kept = [_collapsed((t.as_py() or "").encode().split(), r) for t, r in zip(batch.column(text), runs)]
                names = [n for n, _ in _RUN]
                best = [b and dict(zip(names, b)) for b in map(strongest, runs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(np.diff(words.first), pa.int64()),
                     pa.array([[dict(zip(names, r)) for r in one] for one in runs], _RUNS), pa.array(best, pa.struct(_RUN)),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[key, "n_words", "runs", "best", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, runs (start, length, period, by start and period), best, collapsed.

    A run is a stretch of words with smallest period q and at least max(6, 4q) words that no neighbouring word continues.
    ``best`` is the run with the greatest length by period (ties: first start, then smaller period), null without runs.
    ``collapsed`` are the words joined by one space without those that a run holds after its first period. Null and blank
    texts have no words and no runs, and an empty collapsed text. A text is never cut: it is searched in one task, in memory
    and time in proportion to its words (times the logarithm of their number). Repeated rows and null keys are answered row by
    row; other columns, whatever their names, are neither read nor returned; an empty table gives no rows. Nothing is shuffled.
    Words are compared by 64-bit hashes.
    """
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = T.StructType.fromDDL(f"n_words long, runs array<{_SQL_RUN}>, best {_SQL_RUN}, collapsed string")
    schema = T.StructType([named.schema["key"], *found.fields])
    return named.mapInArrow(_search("key", "text"), schema).withColumnRenamed("key", key)
