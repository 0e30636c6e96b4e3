"""Audit of how sources differ in their words, by in-mapper stripes.

A task folds whole documents into stripes: a hash table from (language, term) to the number of documents that hold the term
and to its occurrences by source. A full table is spilled and started anew. Spilled stripes are dealt and sorted by their key
and merged one after the other, so a reducer holds one stripe; terms in too few documents end there. The merged stripes meet
the totals of their language and emit divergences directly: a task keeps a matrix of summed differences per language and the
strongest terms per source, never the terms themselves.

All arithmetic is on integers; a share is 1 + floor(10^9 * (count + 5) / (total + 5 * terms)).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.session import cut_lineage

LEAST_DOCS = 30
TOP_TERMS = 50
SPILL_ENTRIES = 400_000  # (term, source) pairs that a task holds
CELLS = 2_000_000  # counts that a task turns into shares at once
PSEUDO = 5
_STRIPE = "lang string, term string, n_docs long, sources array<string>, counts array<long>"
_PART = "lang string, source string, part string, item string, value long"
#: A-Z to a-z, other characters outside letters and beyond ASCII to a blank: what is left between blanks is a term.
_TERM_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_STRIPE_KINDS = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
_STRIPE_NAMES = ["lang", "term", "n_docs", "sources", "counts"]
_STRIPES = pa.schema(list(zip(_STRIPE_NAMES, _STRIPE_KINDS)))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of letters A-Z, a-z and characters beyond ASCII, with A-Z lower-cased; null has none."""
    return (text or b"").translate(_TERM_BYTES).split()


class Stripes:
    """The hash table of a task, held by language: documents by term, and occurrences by source and term."""

    def __init__(self):
        self.n_docs: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        self.entries = 0

    def add(self, lang: str, source: str, found: list[bytes]) -> None:
        held = self.counts[lang][source]
        before = len(held)
        held.update(found)
        self.entries += len(held) - before
        self.n_docs[lang].update(set(found))

    def batches(self, step: int = 50_000) -> Iterator[pa.RecordBatch]:
        """A stripe per (language, term): documents, and sources with their counts."""
        for lang, n_docs in self.n_docs.items():
            sources: dict[bytes, list[str]] = {term: [] for term in n_docs}
            counts: dict[bytes, list[int]] = {term: [] for term in n_docs}
            for source, held in self.counts[lang].items():
                for term, n in held.items():
                    sources[term].append(source)
                    counts[term].append(n)
            names = list(n_docs)
            for a in range(0, len(names), step):
                part = names[a:a + step]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array([n_docs[t] for t in part], pa.int64()), pa.array([sources[t] for t in part], _STRIPE_KINDS[3]),
                     pa.array([counts[t] for t in part], _STRIPE_KINDS[4])], names=_STRIPE_NAMES)


def _fold(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Stripes()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                table.add(lang, source, terms(text.as_py()))
                if table.entries >= limit:
                    yield from table.batches()
                    table = Stripes()
        yield from table.batches()
    return run


def joined_stripes(rows: pa.Table) -> pa.Table:
    """One stripe for every run of rows with equal keys: documents added, counts added by source."""
    rows = rows.combine_chunks()
    lang, term, n_docs, sources, counts = (rows.column(c).chunk(0) for c in _STRIPE_NAMES)
    new = np.ones(len(term), bool)
    if len(term) > 1:
        new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    names = sources.flatten().dictionary_encode()
    sizes = np.diff(sources.offsets.to_numpy())
    code = np.repeat(np.cumsum(new) - 1, sizes) * max(len(names.dictionary), 1) + names.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code = code[order]
    cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    group, name = np.divmod(code[cut], max(len(names.dictionary), 1))
    totals = np.add.reduceat(counts.flatten().to_numpy()[order], cut) if len(cut) else np.zeros(0, np.int64)
    edges = pa.array(np.searchsorted(group, np.arange(len(first) + 1)).astype(np.int32))
    return pa.Table.from_arrays(
        [lang.take(pa.array(first)), term.take(pa.array(first)), pa.array(np.add.reduceat(n_docs.to_numpy(), first)),
         pa.ListArray.from_arrays(edges, names.dictionary.take(pa.array(name))), pa.ListArray.from_arrays(edges, pa.array(totals))],
        schema=_STRIPES)


def _merge(least: int):
    """Neighbours with equal keys become one stripe; stripes of too few documents are left out.

    What a batch ends with is one stripe, kept for the next: a task never holds more than a batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _STRIPES.empty_table()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = joined_stripes(pa.concat_tables([last, pa.Table.from_batches([batch]).cast(_STRIPES)]))
            last = found.slice(found.num_rows - 1)
            yield from enough(found.slice(0, found.num_rows - 1))
        yield from enough(last)

    def enough(found: pa.Table) -> list[pa.RecordBatch]:
        return found.filter(pc.greater_equal(found.column("n_docs"), least)).combine_chunks().to_batches()

    return run


def shares(counts: np.ndarray, totals: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * counts / totals), exact for counts up to totals and totals below 9 * 10^13: divided in two steps."""
    high, rest = np.divmod(counts * 100_000, totals)
    return 1 + high * 10_000 + rest * 10_000 // totals


class _Audit:
    """What a task gathers on one language: differences summed by pair of sources, and the strongest terms of each."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], n_terms: int, top: int):
        self.lang, self.sources, self.top = lang, sources, top
        self.column = {s: i for i, s in enumerate(sources)}
        self.totals = np.array(totals, np.int64) + PSEUDO * n_terms
        self.all = int(sum(totals)) + PSEUDO * n_terms
        self.sums = np.zeros((len(sources), len(sources)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in sources]

    def add(self, names: list[str], rows: list[list[str]], counts: list[list[int]]) -> None:
        step = max(1, CELLS // len(self.sources))
        for a in range(0, len(names), step):
            self._add([n.encode() for n in names[a:a + step]], rows[a:a + step], counts[a:a + step])

    def _add(self, names: list[bytes], rows: list[list[str]], counts: list[list[int]]) -> None:
        held = np.zeros((len(names), len(self.sources)), np.int64)
        for i, (by, ns) in enumerate(zip(rows, counts)):
            held[i, [self.column[s] for s in by]] = ns
        own = shares(held + PSEUDO, self.totals)
        common = shares(held.sum(axis=1) + PSEUDO, self.all)
        for i in range(len(self.sources)):
            self.sums[i] += np.abs(own - own[:, [i]]).sum(axis=0)
            over = own[:, i] - common
            at = np.flatnonzero((held[:, i] > 0) & (over > 0))
            if len(at) > self.top:  # all at or above the value of rank ``top``, ties included
                at = at[over[at] >= np.partition(over[at], len(at) - self.top)[len(at) - self.top]]
            new = [(-int(over[k]), names[k]) for k in at.tolist()]
            self.best[i] = sorted(self.best[i] + new)[:self.top]

    def rows(self) -> Iterator[tuple]:
        for i, source in enumerate(self.sources):
            for j, other in enumerate(self.sources):
                if i != j:
                    yield self.lang, source, "pair", other, int(self.sums[i, j])
            for value, term in self.best[i]:
                yield self.lang, source, "term", term.decode(), -value


def _diverge(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audits: dict[str, _Audit] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            edges = [i for i in range(len(langs)) if i == 0 or langs[i] != langs[i - 1]] + [len(langs)]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if langs[a] not in audits:
                    audits[langs[a]] = _Audit(langs[a], *(part.column(c)[0].as_py() for c in ("groups", "totals", "n_terms")), top)
                audits[langs[a]].add(*(part.column(c).to_pylist() for c in ("term", "sources", "counts")))
        for audit in audits.values():
            rows = list(audit.rows())
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.string()] * 4 + [pa.int64()])],
                names=["lang", "source", "part", "item", "value"])
    return run


def term_stripes(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                 least_docs: int = LEAST_DOCS, spill: int = SPILL_ENTRIES) -> DataFrame:
    """lang, term, n_docs, sources and counts of every term in at least ``least_docs`` documents of its language."""
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (named.mapInArrow(_fold(spill), _STRIPE).repartition(width, "lang", "term")
            .sortWithinPartitions("lang", "term").mapInArrow(_merge(least_docs), _STRIPE))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                      least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, spill: int = SPILL_ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and in which terms.

    Part ``pair``: item is another source of the language, value the sum over the kept terms of the absolute difference of
    their shares, all ranks. Part ``term``: item is a kept term that the source holds with a larger share than its language,
    value the difference, the ``top`` largest. Ranks go by value, then item. Null text, language and source count as empty;
    a source without any term is compared like the others; a language without kept terms has pairs of value 0, one with a
    single source none. Whole texts are counted, every repeated row is a document of its own; other columns are not read; an
    empty table gives no rows. Totals and shares are exact while a language has fewer than 9 * 10^13 words.

    The answer has the square of a language's sources; tasks hold that many sums for the language they work on.
    """
    stripes = cut_lineage(term_stripes(docs, text, lang, source, least_docs, spill))
    groups = cut_lineage(docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))])
                         .distinct())
    counted = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy(
        "lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    vocabulary = stripes.groupBy("lang").agg(F.count("*").alias("n_terms"))
    totals = groups.join(counted, ["lang", "source"], "left").groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("g"))
    profiles = totals.join(vocabulary, "lang").select(
        "lang", F.col("g.source").alias("groups"), F.col("g.total").alias("totals"), "n_terms")
    found = stripes.join(profiles, "lang").select("lang", "term", "sources", "counts", "groups", "totals", "n_terms")
    parts = cut_lineage(found.mapInArrow(_diverge(top), _PART))
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    every = pairs.join(sums, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = every.unionByName(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(place))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
