"""Quality rules as a short-circuit cascade of column expressions.

Every rule is a boolean column that is true where it rejects. On a sample each rule's seconds and share of rejected rows
are measured; rules then run in the order of rejections per second, as branches of one CASE, so an expensive rule only
sees what the earlier ones let through. The order changes the time, never the verdict. No Python runs on executors.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.session import cut_lineage

SAMPLE_ROWS = 2000
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


@dataclass(frozen=True)
class Measured:
    """What a rule costs and rejects on the sample."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long")


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included.

    Windows meet as 64-bit hashes: sorted with their places, equal neighbours repeat; of the places found, each covers the
    words up to the next one. Texts whose windows all differ, the common case, leave after one hash set.
    """
    hashed = F.when(F.size(words) < width, F.array().cast("array<bigint>")).otherwise(F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)])),
        F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0))))

    def covered(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"])
                         | (x["h"] == F.get(ordered, i + 1)["h"]))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))),
            F.lit(0), lambda total, x: total + x))

    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))).cast("long")


def counts(text: str = "text") -> dict[str, Column]:
    """The counts that rules need, as expressions of the text column. Null counts as empty."""
    t = text_of(text)
    return {"body": t, "n_words": F.size(words_of(t)).cast("long"), "word_chars": word_chars(t),
            "n_symbols": symbol_count(t), "n_dup_lines": repeated_lines(t)}


def base_rules(text: str = "text") -> list[Rule]:
    """Too few words, or more than half of them in repeated windows."""
    t = text_of(text)
    return [Rule("short", F.size(words_of(t)) < 50),
            Rule("repeated_words", let(words_of(t), lambda w: 100 * repeated_words(w) > 50 * F.size(w)))]


def more_rules(have: dict[str, Column]) -> list[Rule]:
    """Rules of the cascade beside the base, over the expressions of ``counts`` or over columns that hold them."""
    t, n = have["body"], have["n_words"]
    letters = F.greatest(have["word_chars"], F.lit(1))
    return [
        Rule("symbols", 10 * have["n_symbols"] > n),
        Rule("upper_case", 100 * F.regexp_count(t, F.lit(r"\p{Lu}")) > 40 * letters),
        Rule("exclamations", 10 * F.regexp_count(t, F.lit("[!?]")) > 3 * n),
        Rule("digits", 100 * F.regexp_count(t, F.lit("[0-9]")) > 40 * letters),
        Rule("word_length", (letters < 2 * n) | (letters > 15 * n)),
        Rule("repeated_lines", 100 * have["n_dup_lines"] > 60 * F.regexp_count(t, F.lit("\n"))),
    ]


def measure(sample: DataFrame, rules: list[Rule]) -> list[Measured]:
    """Seconds and share of rejected rows of each rule on ``sample``, best first. An empty sample keeps the given order."""
    rows = sample.count()
    found = []
    for rule in rules:
        spent, hits = None, 0
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            hits = sample.agg(F.count_if(rule.rejects)).first()[0]
            spent = min(spent or 1e9, time.perf_counter() - start)
        found.append(Measured(rule, spent, hits / max(rows, 1)))
    return sorted(found, key=lambda m: -m.worth) if rows else found


def take_sample(docs: DataFrame, columns: list[str], rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """About ``rows`` rows spread over the whole table, written once."""
    share = min(1.0, rows / max(docs.count(), 1))
    return cut_lineage(docs.select(*columns).sample(False, share, seed))


def cascade(rules: list[Rule]) -> Column:
    """True where a rule rejects; each rule is evaluated only where all earlier ones did not."""
    verdict = F.lit(False)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(True)).otherwise(verdict)
    return verdict


def ordered_rules(docs: DataFrame, columns: list[str], rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    return [m.rule for m in measure(take_sample(docs, columns, sample_rows), rules)]


def keep_good(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None,
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns. Repeated rows are judged alike; empty tables stay empty."""
    rules = rules or base_rules(text) + more_rules(counts(text))
    return docs.where(~cascade(ordered_rules(docs, [text], rules, sample_rows)))


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The counts are computed for every row; the cascade of the other rules only decides rows that the base lets pass. Null
    texts count as empty and fail the base; other columns are ignored, whatever their names.
    """
    names = ["body", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("body"))
    words = let(words_of(F.col("body")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    counted = rows.withColumn("w", words).select(
        "id", "body", "w.n_words", word_chars(F.col("body")).alias("word_chars"),
        symbol_count(F.col("body")).alias("n_symbols"), repeated_lines(F.col("body")).alias("n_dup_lines"),
        "w.n_repeat_words")
    sample = docs.select(F.col(text).alias("text")).select(*[c.alias(n) for n, c in counts().items()])
    order = ordered_rules(sample, names, more_rules({n: F.col(n) for n in names}), sample_rows)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        F.col("id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.when(failed, False).otherwise(~cascade(order)).alias("kept"))
