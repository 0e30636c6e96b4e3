"""Facility numbers, district names and the insert/delete similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.deletions import letters
from fieldpulse.functions.values import col
from fieldpulse.schemas import NOT_FOUND

# ---- fixed values: spellings of the plant prefix and of the district suffixes
PLANT_PREFIX = r"^цтп(?=.)-*(.*?)-*$"
NUMBER_NOISE = r"[№#\s\p{Z}]"
DISTRICT_SUFFIX = r"[\s\p{Z}]*(г\.о\.|г\.)[\s\p{Z}]*"
PLANT_MENTION = r"(?iu)(цтп[\s\p{Z}]*[-№#]*[\s\p{Z}]*[0-9][0-9-]*)"
# ---- end of fixed values


def norm_number(c: Column | str) -> Column:
    """Facility name reduced to its number: 'ЦТП № 1--3-4' gives '1-3-4'; other names only lose noise signs."""
    text = F.regexp_replace(F.lower(col(c)), NUMBER_NOISE, "")
    return F.regexp_replace(F.regexp_replace(text, "-+", "-"), PLANT_PREFIX, "$1")


def clean_district(c: Column | str) -> Column:
    """District name without its administrative suffix."""
    return F.trim(F.regexp_replace(col(c), DISTRICT_SUFFIX, ""))


def usable_extraction(c: Column | str) -> Column:
    """The extracted name, or NULL when nothing was found in the claim."""
    c = col(c)
    return F.when((c != "") & (F.lower(F.trim(c)) != NOT_FOUND), c)


def extract_plant(c: Column | str) -> Column:
    """Default extraction of the plant's name from a claim text: its first mention, else the not-found word."""
    return F.coalesce(F.trim(F.regexp_substr(col(c), F.lit(PLANT_MENTION))), F.lit(NOT_FOUND))


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence, one dynamic-programming row per character of ``a``.

    The row is an array over the characters of ``b``; all of it stays inside one expression on the JVM.
    """
    a, b = col(a), col(b)
    letters_b = F.split(b, "")
    start = F.transform(letters_b, lambda _: F.lit(0))

    def next_row(row: Column, letter: Column) -> Column:
        # walk over b, carrying the cell to the left; the cell above-left is row[i - 1]
        return F.aggregate(
            F.sequence(F.lit(0), F.size(letters_b) - 1),
            F.slice(row, 1, 0),
            lambda out, i: F.concat(out, F.array(F.when(
                F.get(letters_b, i) == letter, F.coalesce(F.get(row, i - 1), F.lit(0)) + 1,
            ).otherwise(F.greatest(F.get(row, i), F.coalesce(F.get(out, i - 1), F.lit(0)))))),
        )

    filled = F.aggregate(F.split(a, ""), start, next_row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(filled, -1))


def indel_ratio(a: Column | str, b: Column | str) -> Column:
    """Similarity 0..100 under insertions and deletions: 200 * LCS / (len a + len b)."""
    a, b = col(a), col(b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs_length(a, b) / total)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One dynamic-programming cell at a time for all pairs of the same two lengths."""
    for batch in batches:
        score = np.zeros(batch.num_rows)
        for n, rows, a in letters(batch.column(0)):
            for m, some, b in letters(batch.column(1).take(pa.array(rows))):
                here = a[some].T
                before = np.zeros((m + 1, len(some)), np.int32)
                for i in range(n):
                    row = np.zeros_like(before)
                    for j in range(m):
                        row[j + 1] = np.where(here[i] == b[:, j], before[j] + 1, np.maximum(before[j + 1], row[j]))
                    before = row
                score[rows[some]] = 200.0 * before[m] / (n + m) if n + m else 100.0
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])


def with_indel_ratio(pairs: DataFrame) -> DataFrame:
    """Adds the ``indel_ratio`` of two columns of texts, neither null, as ``score``: many pairs at a time."""
    a, b = pairs.columns
    return pairs.mapInArrow(_scored, f"{a} string, {b} string, score double")
