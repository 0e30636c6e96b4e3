"""Personal data and the terms that give it away.

Patterns find protected entities. How much a term discloses of them is estimated from the corpus: with N documents, n_c
holding the entity, n_t the term and n_ct both, wherever they stand, the pointwise mutual information log2(N n_ct / (n_c n_t))
is compared with the information content of the entity, log2(N / n_c). A ratio of one means that the term alone names the
entity. The counts are those of the whole table and equal texts count once, so no least number of documents is asked for: a
word found in one document only names the entities of that document. Terms at or above the threshold are removed from the
documents that hold the entity; entities are generalised to their kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.words import slices, split_words
from fieldpulse.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
DISCLOSURE = 0.95
MOST_TERMS = 1 << 20
MOST_COPIES = 1 << 18
COMMON = 0.002

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @ the longest local part on its left; linear also in long texts without blanks."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            after = domain.end()
            yield start, after
        at = text.find("@", max(after, at + 1))


def small_parts(address: str) -> bool:
    parts = [p.lstrip("0") for p in address.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def find_entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind."""
    found = []
    if "@" in text:
        found += [("email", s, e) for s, e in emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if small_parts(m[0])]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    names = split_words(pa.array([f"{k}:{text[s:e]}".replace(" ", "_") for k, s, e in spans], pa.string()))
    return np.unique(names.hashes().view(np.int64)).tolist()


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            base, entities, kept = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                spans = find_entities(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                entities.append(_entities(text, spans) if spans else [])
                kept.append(text if spans else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("digest"), pa.array(base, _SPAN_TYPE),
                 pa.array(entities, pa.list_(pa.int64())), pa.array(kept, pa.string())],
                names=["row", "id", "digest", "base", "entities", "text"])


def _terms(common: np.ndarray):
    """The distinct words of each text as (row, term), without those in ``common``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = split_words(batch.column("text"), lower=True)
                hashes = words.hashes().view(np.int64)
                docs = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
                rest = ~np.isin(hashes, common)
                hashes, docs = hashes[rest], docs[rest]
                order = np.lexsort((hashes, docs))
                hashes, docs = hashes[order], docs[order]
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])][:len(hashes)]
                rows = batch.column("row").to_numpy()[docs[new]]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(hashes[new], pa.int64())],
                                                 names=["row", "term"])
    return run


def _document_frequency(wanted: np.ndarray | None):
    """Counts of documents per term, summed inside the task before they are sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            terms, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64))], names=["term", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                words = split_words(batch.column("text"), lower=True)
                hashes = words.hashes().view(np.int64)
                docs = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, hashes), max(len(wanted) - 1, 0))
                    hit = wanted[at] == hashes if len(wanted) else np.zeros(len(hashes), bool)
                    hashes, docs = hashes[hit], docs[hit]
                order = np.lexsort((hashes, docs))
                hashes, docs = hashes[order], docs[order]
                if len(hashes):
                    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])]
                    held.append(hashes[new])
                    size += len(held[-1])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
    return run


def one_of_each(rows: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """The distinct texts of ``rows``. Only texts that have copies are shuffled, unless more than ``most`` texts have some."""
    copied = cut_lineage(found.groupBy("digest").count().where("count > 1").select("digest"))
    if copied.limit(most + 1).count() > most:
        return rows.dropDuplicates(["digest"]).select("text")
    once = rows.join(F.broadcast(copied), "digest", "left_semi").dropDuplicates(["digest"])
    return rows.join(F.broadcast(copied), "digest", "left_anti").select("text").unionByName(once.select("text"))


def _longs(df: DataFrame) -> np.ndarray:
    return np.sort(df.toArrow().column(0).to_numpy())


def risky_terms(found: DataFrame, rows: DataFrame, disclosure: float, most_copies: int) -> DataFrame:
    """(row, terms): words of the row whose ratio of mutual information to information content reaches ``disclosure``."""
    total = found.select("digest").distinct().count()
    holding = found.where("text IS NOT NULL")
    first = cut_lineage(holding.groupBy("digest").agg(F.min("row").alias("row")).select("row"))
    distinct = holding.join(first, "row", "left_semi")

    # entities of the same documents are one: they are known by the digests that hold them
    held = distinct.select(F.explode("entities").alias("entity"), "digest").groupBy("entity").agg(
        F.count("*").alias("n_c"), F.bit_xor(F.xxhash64("digest")).alias("holders")).where(F.col("n_c") < total)
    held = cut_lineage(holding.select("row", F.explode("entities").alias("entity")).join(held, "entity").select(
        "row", "n_c", "holders").distinct())

    terms = cut_lineage(distinct.select("row", "text").mapInArrow(
        _terms(np.zeros(0, np.int64)), "row long, term long").select("term").distinct())
    few = terms.count() <= MOST_TERMS  # 8 MB at most go to the tasks; beyond, all terms are counted
    frequency = one_of_each(rows, found, most_copies).mapInArrow(
        _document_frequency(_longs(terms) if few else None), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    frequency = cut_lineage(frequency if few else frequency.join(terms, "term"))

    # n_ct is at most n_c, so a term in more documents than this gives no entity away
    limit = total * F.pow(F.col("n_c") / total, F.lit(disclosure)) * (1 + 1e-9)
    most = held.agg(F.max(limit)).first()[0] or 0.0
    common = _longs(frequency.where(F.col("n_t") > max(most, COMMON * total)).select("term"))
    pairs = holding.select("row", "text").mapInArrow(_terms(common), "row long, term long").join(
        frequency.where(F.col("n_t") <= most), "term").join(held, "row").where(F.col("n_t") <= limit)
    pairs = cut_lineage(pairs.select("row", "holders", "n_c", "term", "n_t"))
    information = F.log2(total / F.col("n_c"))
    mutual = F.log2(total * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    risky = pairs.join(first, "row", "left_semi").groupBy("holders", "n_c", "term", "n_t").agg(
        F.count("*").alias("n_ct")).where(mutual >= disclosure * information).select("holders", "term")
    return pairs.join(risky, ["holders", "term"], "left_semi").groupBy("row").agg(F.collect_set("term").alias("terms"))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_spans, clean = [], []
        for text, base, terms in zip(batch.column("text").to_pylist(), batch.column("base").to_pylist(),
                                     batch.column("terms").to_pylist()):
            spans = [(s["kind"], s["start"], s["end"]) for s in base]
            words = split_words(pa.array([text], pa.string()), lower=True)
            hits = np.flatnonzero(np.isin(words.hashes().view(np.int64), np.array(terms or [], np.int64)))
            raw, at, size, marked = text.encode(), 0, 0, []
            taken = [(s, e) for _, s, e in spans]
            for w in hits:
                start, end = int(words.starts[w]), int(words.ends[w])
                size += len(raw[at:start].decode())
                length = len(raw[start:end].decode())
                if not any(s < size + length and size < e for s, e in taken):
                    marked.append((TERM, size, size + length))
                size += length
                at = end
            order = {k: i for i, k in enumerate((*KINDS, TERM))}
            spans = sorted(spans + marked, key=lambda x: (x[1], order[x[0]]))
            all_spans.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            clean.append(sanitised(text, spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(all_spans, _SPAN_TYPE), pa.array(clean, pa.string())],
            names=["row", "spans", "clean"])


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Entities become their kind in brackets, terms go; of overlapping spans the first one names the whole stretch."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], "" if kind == TERM else f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE,
             most_copies: int = MOST_COPIES) -> DataFrame:
    """One row per input row: key, ``base`` (entities), ``spans`` (with the disclosing terms), ``clean`` (the new text).

    Spans are (kind, start, end) in code points, end exclusive. ``clean`` is null where nothing changes. Null counts as
    empty and holds nothing; equal texts are one document in all counts and are all cleaned; a null key is returned as it
    is. Other columns are ignored. Terms are words in lower case anywhere in a document that holds the entity.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"),
                       F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"), F.col(text).alias("text"))
    found = cut_lineage(rows.mapInArrow(
        _find, f"row long, id long, digest binary, base {_SPANS}, entities array<long>, text string"))
    terms = risky_terms(found, rows, disclosure, most_copies)
    marked = found.where("text IS NOT NULL").select("row", "base", "text").join(terms, "row", "left").mapInArrow(
        _mark, f"row long, spans {_SPANS}, clean string")
    return found.select("row", "id", "base").join(marked, "row", "left").select(
        F.col("id").alias(key), "base", F.coalesce("spans", "base").alias("spans"), "clean")
