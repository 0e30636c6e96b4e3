"""The registered queries of this subpackage and their SQL: the operators with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.llm import (
    byte_bpe, divergence, embedding_dedup, exact_dedup, mixing, ngram_join, periodic_runs, pii, quality, secret_scan,
    substring_dedup, token_counts, url_filter,
)

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.similar_components(documents(spark, folder), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def bpe_round_trip(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, n_tokens, and digests of the ids and of the bytes they decode to."""
    coded = byte_bpe.encode(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, keep, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"))


def byte_bpe_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_round_trip(documents(spark, folder), ["doc_id"])


def url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"))


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, folder))
    counts = [secret_scan.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listing(F.col("spans"), secret_scan.BASE), 256).alias("base_sha256"),
                        secret_scan.listing(F.col("spans")).alias("spans"))


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, folder))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                        F.round("__target", 6).alias("target"), F.col("__taken").alias("taken"))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(documents(spark, folder))


def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.sanitise(documents(spark, folder))
    counts = [secret_scan.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listing(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.listing(F.col("spans")).alias("spans"))


def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, folder)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, folder))


def counted_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), public_tokenizers.path(PIECES))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document by the checksum of its id repeats a part of its words to the end."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = docs.select("doc_id", "text", F.floor(checksum / 10).alias("g"), F.when(checksum % 10 == 0, words).alias("w"))
    n = F.size("w")
    at = F.col("g") % n
    period = 1 + F.floor((n - at) / (3 + F.col("g") % 8))
    parts = parts.select("*", at.cast("int").alias("at"), period.cast("int").alias("p"))
    rest = F.flatten(F.array_repeat(F.slice("w", F.col("at") + 1, F.col("p")), F.ceil((n - F.col("at")) / F.col("p")).cast("int")))
    repeated = F.slice(F.concat(F.slice("w", F.lit(1), F.col("at")), rest), F.lit(1), n)
    return parts.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def repeated_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted(documents(spark, folder)))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"))


def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_similar_documents": similar_documents,
    "op2_byte_bpe": byte_bpe_ids,
    "op3_url_filter": url_verdicts,
    "op4_secret_scan": secrets,
    "op5_source_mix": source_mix,
    "op6_quality_rules": quality_rules,
    "op7_personal_data": personal_data,
    "op8_repeated_passages": repeated_passages,
    "op9_exact_duplicates": exact_duplicates,
    "op10_token_counts": counted_tokens,
    "op11_periodic_runs": repeated_runs,
    "op12_near_vectors": near_vectors,
    "op13_source_divergence": source_divergence,
}

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SIMILAR = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams AS a JOIN grams AS b USING (g)
    WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sets AS x ON x.doc_id = a JOIN sets AS y ON y.doc_id = b
    WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN links ON a = doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM sets AS s JOIN reach AS r USING (doc_id) GROUP BY s.doc_id, s.s"""


def _fits(entry: url_filter.Entry) -> str:
    return (f"((host = '{entry.host}' OR ends_with(host, '.{entry.host}')) AND starts_with(path, '{entry.path}'))")


_LONGEST_FIRST = sorted(url_filter.RULES, key=lambda e: -len(e.text))
_URLS = rf"""
WITH parts AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(e)} THEN '{e.text}'" for e in _LONGEST_FIRST)} END AS rule,
    CASE {" ".join(f"WHEN {_fits(e)} THEN '{e.verdict}'" for e in _LONGEST_FIRST)}
        WHEN {" OR ".join(_fits(url_filter.Entry("block", h)) for h in url_filter.BLOCKED_HOSTS)} THEN 'block'
        ELSE 'allow' END AS verdict
FROM parts"""

_MIX = rf"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
        len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>0-9]')) AS marks,
        (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/1'), 1, 12) AS BIGINT) AS DOUBLE) + 1)
            / 281474976710657.0 AS u FROM documents),
keyed AS (SELECT *, -ln(u) / (CAST(size + 1 AS DOUBLE) / (size + 1 + marks)) AS k FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
placed AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
    CAST(2 * source_size AS DOUBLE) AS cap FROM sources),
leveled AS (
    SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM placed),
planned AS (SELECT source, source_size, least(cap, coalesce(
    max(CASE WHEN level < cap / weight THEN level END) OVER () * weight, cap)) AS target FROM leveled),
summed AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY p.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS before FROM keyed JOIN planned AS p ON keyed.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
    CAST(size * (epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed"""

_QUALITY = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
counts AS (
    SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))
            - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM words LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(word_chars, 1) AS letters FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > n_words OR 100 * len(regexp_extract_all(t, '\p{{Lu}}')) > 40 * letters
        OR 10 * len(regexp_extract_all(t, '[!?]')) > 3 * n_words OR 100 * len(regexp_extract_all(t, '[0-9]')) > 40 * letters
        OR letters < 2 * n_words OR letters > 15 * n_words
        OR 100 * n_dup_lines > 60 * len(regexp_extract_all(t, '\n'))) AS kept
FROM judged"""

_PASSAGES = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
again AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM again),
kept AS (SELECT doc_id, p, x FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM words)
    ANTI JOIN gone USING (doc_id, p)),
texts AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN texts USING (doc_id)"""

_EXACT = r"""
WITH plain AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
ranked AS (SELECT *, first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS place,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM plain
    WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM ranked"""

_RUNS = rf"""
WITH bytes AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295,
        list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda x, c: list_reduce(list_prepend(xor(x, c), range(8)), lambda y, k: CASE WHEN y % 2 = 1
                THEN xor(y // 2, 3988292384) ELSE y // 2 END))) END AS h FROM documents),
parts AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM bytes),
texts AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i
        ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END]) END AS w FROM parts),
grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS s
    FROM (SELECT doc_id, w, len(w) AS n, unnest(range(len(w) - 4)) AS i FROM texts WHERE len(w) >= 6)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams AS x JOIN grams AS y ON x.doc_id = y.doc_id AND x.s = y.s
    AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
matched AS (SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 5 + q AS l FROM islands GROUP BY doc_id, q, k),
runs AS (SELECT * FROM matched WHERE l >= greatest(6, 4 * q)
    QUALIFY row_number() OVER (PARTITION BY doc_id, s, l ORDER BY q) = 1),
listed AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
best AS (SELECT x.* FROM runs AS x WHERE NOT EXISTS (SELECT 1 FROM runs AS y WHERE y.doc_id = x.doc_id
    AND (y.l * x.q > x.l * y.q OR (y.l * x.q = x.l * y.q AND (y.s < x.s OR (y.s = x.s AND y.q < x.q)))))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t
    FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM texts) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(listed.n, 0) AS BIGINT) AS n_runs, best.s AS start, CAST(best.l AS BIGINT) AS length,
    best.q AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256,
    sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM texts AS t LEFT JOIN listed USING (doc_id) LEFT JOIN best ON best.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id"""

_VECTORS = r"""
WITH RECURSIVE sound AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound AS x JOIN sound AS y ON x.label = y.label AND x.vec_id <> y.vec_id
    AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
reach AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT b, root FROM reach JOIN links ON a = vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
roots AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN counted USING (vec_id)"""

_DIVERGENCE = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(*) >= 30),
counts AS (SELECT lang, source, term, sum(n) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM groups AS g JOIN kept AS k USING (lang)
    LEFT JOIN counts AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shared AS (SELECT *, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p
    FROM filled),
whole AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL),
common AS (SELECT lang, term, 1 + 1000000000 * (CAST(n AS HUGEINT) + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
    FROM whole),
rows AS (
    SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(v, 0) AS value
    FROM groups AS g JOIN groups AS o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN (
        SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS v FROM shared AS x JOIN shared AS y
            ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) AS s ON s.lang = g.lang AND s.source = g.source AND s.other = o.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM shared JOIN common USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item) ASC) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR rank <= 50"""

#: The others (merges by rank, pieces, spans of matches with digests) are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_similar_documents": _SIMILAR,
    "op3_url_filter": _URLS,
    "op5_source_mix": _MIX,
    "op6_quality_rules": _QUALITY,
    "op8_repeated_passages": _PASSAGES,
    "op9_exact_duplicates": _EXACT,
    "op11_periodic_runs": _RUNS,
    "op12_near_vectors": _VECTORS,
    "op13_source_divergence": _DIVERGENCE,
}
