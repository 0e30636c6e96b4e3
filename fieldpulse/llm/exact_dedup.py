"""Exact duplicates by Grace hashing.

Records are dealt to buckets by a digest of their content; shuffle files are the spill files. A bucket streams through an
open-addressing table that compares complete content. Records that no longer fit its table go, whole groups at a time, to
the next round, which deals them anew with another hash, until every bucket fits. Before the first deal every input task
collapses its own copies with the same table, so a text that fills a third of all rows reaches its bucket once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldpulse.llm.words import BLANKS, slices
from fieldpulse.session import cut_lineage

TABLE_BYTES = 64 << 20
_RECORDS = "row long, id long, n_chars long, head long, digest binary, text binary"
_ROUND = "head long, leader long, digest binary, text binary"


class ContentTable:
    """First row seen of each content. A dict of bytes is an open-addressing table that compares whole keys."""

    def __init__(self, limit: int):
        self.rows: dict[bytes, int] = {}
        self.room = limit

    def place(self, content: bytes, row: int) -> tuple[int | None, bool]:
        """The row that holds this content (None: no room for a new one) and whether it was placed now."""
        held = self.rows.get(content)
        if held is not None:
            return held, False
        if self.room < 0 and self.rows:
            return None, False
        self.room -= len(content) + 160
        self.rows[content] = row
        return row, True


def normalised(text: bytes | None) -> bytes:
    """The text without blanks, tabs and line breaks; null is empty."""
    return (text or b"").translate(None, BLANKS)


def _collapse(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(limit)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts, rows = batch.column("text").cast(pa.binary()), batch.column("row").to_pylist()
            heads, digests, sent = [], [], []
            for text, row in zip(texts, rows):
                text = text.as_py()
                content = normalised(text)
                head, new = table.place(content, row)
                heads.append(row if head is None else head)
                digests.append(hashlib.sha256(content).digest())
                sent.append(content if new or head is None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("n_chars"), pa.array(heads, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(sent, pa.binary())],
                names=["row", "id", "n_chars", "head", "digest", "text"])
    return run


def _bucket(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable(limit)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            heads, leaders, digests, left = batch.column("head").to_pylist(), [], [], []
            for head, digest, content in zip(heads, batch.column("digest"), batch.column("text")):
                leader, _ = table.place(content.as_py(), head)
                leaders.append(leader)
                digests.append(digest.as_py() if leader is None else None)
                left.append(content.as_py() if leader is None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("head"), pa.array(leaders, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(left, pa.binary())], names=["head", "leader", "digest", "text"])
    return run


def _leaders(records: DataFrame, table_bytes: int) -> DataFrame:
    """(head, leader) for every local group: rounds of partitioning until no bucket overflows."""
    spark = records.sparkSession
    left, done, level = records.where("text IS NOT NULL").select("head", "digest", "text"), None, 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = left.agg(F.sum(F.octet_length("text") + 160)).first()[0] or 0
    while True:
        buckets = max(width, 2 * size // table_bytes + 1)
        dealt = left.repartition(int(buckets), F.xxhash64("digest", F.lit(level)))
        solved = cut_lineage(dealt.mapInArrow(_bucket(table_bytes), _ROUND))
        part = solved.where("leader IS NOT NULL").select("head", "leader")
        done = part if done is None else done.unionByName(part)
        left = solved.where("leader IS NULL").select("head", "digest", "text")
        size = left.agg(F.sum(F.octet_length("text") + 160)).first()[0] or 0
        if not size:
            return done
        level += 1


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without blanks, tabs and line breaks; null counts as empty. The row with the most code
    points in its original text stays, then the smallest key (a null key comes last), then, of rows repeated with the same
    key, the one read first: exactly one row of a group is kept. Other columns are neither read nor returned; an empty
    table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"),
                       F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), F.col(text).alias("text"))
    records = cut_lineage(rows.mapInArrow(_collapse(table_bytes), _RECORDS))
    leaders = _leaders(records, table_bytes)
    members = records.select("row", "id", "n_chars", "head", "digest").join(leaders, "head").drop("head")
    # a written table, so that the join on large groups can be split
    groups = cut_lineage(members.groupBy("leader").agg(
        F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "row")).alias("best"),
        F.count("*").alias("group_size")))
    return members.join(groups, "leader").select(
        F.col("id").alias(key), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    blanks = BLANKS.decode()
    digest = F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), blanks, ""), 256)
    kept = duplicate_groups(docs, key, text, table_bytes).where("kept").select(
        F.col(key).alias("__id"), F.col("text_sha256").alias("__kept"))
    size = F.coalesce(F.length(text), F.lit(0))
    one = Window.partitionBy(key, "__digest").orderBy(size.desc())
    found = docs.withColumn("__digest", digest).join(
        kept, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept")), "left_semi")
    return found.withColumn("__place", F.row_number().over(one)).where("__place = 1").select(*docs.columns)
