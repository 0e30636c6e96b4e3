"""URL filters over a sorted array of digests.

A filter list becomes one file: 64-bit xxhash keys in order, then the entries themselves in the same order. Every task maps
the file into memory, so the workers of a machine share one copy. For each URL the keys of all entries that could fit it
(its host and all parent hosts, with the path cut to each length that entries have) are probed by one vectorised binary
search; a hit counts once the stored string is the same.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.session import shared_folder

MOST_ENTRIES = 20_000_000


@dataclass(frozen=True)
class Entry:
    """A host with all its subdomains and a prefix of paths. ``rule`` entries are named in the result."""

    verdict: str
    host: str
    path: str = ""
    rule: bool = True

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules that go before the list.
RULES = [Entry("block", "net", "/"), Entry("allow", "example.net", "/en/"), Entry("block", "example.com", "/de/"),
         Entry("allow", "org", "/fr/")]
#: The production block list: whole hosts with their subdomains.
BLOCKED_HOSTS = ["ads-track.example.com", "casino-win.example.net", "spam-farm.example.org", "adult-x.example.com",
                 "cheap-pills.example.net", "free-bets.example.net"]


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def pack(entries: list[Entry], hash_of=digest) -> bytes:
    """Header, keys, offsets, flags and strings. Entries repeated with another verdict keep the first one."""
    once = list({(e.host, e.path, e.rule): e for e in reversed(entries)}.values())
    if len(once) > MOST_ENTRIES:
        raise ValueError(f"the list has {len(once)} entries; {MOST_ENTRIES} are shipped to every machine at most")
    order = sorted((hash_of(f"{e.host}\n{e.path}"), e.host, e.path, e.rule, e.verdict) for e in once)
    strings = [f"{host}\n{path}".encode() for _, host, path, _, _ in order]
    offsets = np.cumsum([0, *map(len, strings)]).astype("<u8")
    lengths = sorted({len(path) for _, _, path, _, _ in order})
    flags = np.array([(verdict == "block") + 2 * rule for _, _, _, rule, verdict in order], np.uint8)
    head = struct.pack("<QQ", len(order), len(lengths)) + np.array(lengths, "<u8").tobytes()
    keys = np.array([k for k, *_ in order], "<u8")
    return head + keys.tobytes() + offsets.tobytes() + flags.tobytes() + b"".join(strings)


class DigestList:
    """A packed list, mapped into memory."""

    def __init__(self, path: str, hash_of=digest):
        data = np.memmap(path, np.uint8, "r")
        n, m = struct.unpack("<QQ", data[:16].tobytes())
        at = 16 + 8 * m
        self.lengths = data[16:at].view("<u8").tolist()
        self.keys = data[at:at + 8 * n].view("<u8")
        self.offsets = data[at + 8 * n:at + 16 * n + 8].view("<u8")
        self.flags = data[at + 16 * n + 8:at + 17 * n + 8]
        self.strings = data[at + 17 * n + 8:]
        self.hash_of = hash_of

    def probe(self, texts: list[str]) -> list[list[int]]:
        """For each text the numbers of the entries that are exactly it."""
        if not texts or not len(self.keys):
            return [[] for _ in texts]
        keys = np.array([self.hash_of(t) for t in texts], np.uint64)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        found: list[list[int]] = [[] for _ in texts]
        for i in np.flatnonzero(high > low):
            wanted = texts[i].encode("utf-8", "surrogatepass")
            found[i] = [k for k in range(low[i], high[i])
                        if self.strings[int(self.offsets[k]):int(self.offsets[k + 1])].tobytes() == wanted]
        return found

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str]]:
        """The rule that fits (the longest; None without one) and the verdict of each address."""
        texts, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            if not host:
                continue
            cuts = [path[:n] for n in self.lengths if n <= len(path)]
            at = 0
            while True:
                for cut in cuts:
                    texts.append(f"{host[at:]}\n{cut}")
                    owner.append(i)
                dot = host.find(".", at)
                if dot < 0:
                    break
                at = dot + 1
        best: list[tuple[int, str, bool] | None] = [None] * len(hosts)
        listed = [False] * len(hosts)
        for i, text, hits in zip(owner, texts, self.probe(texts)):
            for k in hits:
                flag = int(self.flags[k])
                if not flag & 2:
                    listed[i] |= bool(flag & 1)
                elif best[i] is None or len(text) > best[i][0]:
                    best[i] = (len(text), text.replace("\n", ""), bool(flag & 1))
        return [(b[1], "block" if b[2] else "allow") if b else (None, "block" if out else "allow")
                for b, out in zip(best, listed)]


def ship(spark: SparkSession, entries: list[Entry]) -> str:
    """Write the list to the shared folder and have every machine fetch it; returns its name there."""
    name = f"urls-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(pack(entries)))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def _judge(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = DigestList(SparkFiles.get(name))
        for batch in batches:
            judged = filters.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("host"), batch.column("path"),
                 pa.array([r for r, _ in judged], pa.string()), pa.array([v for _, v in judged], pa.string())],
                names=["id", "host", "path", "rule", "verdict"])
    return run


def lower_ascii(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[Entry] | None = None,
               blocked_hosts: list[str] | None = None) -> DataFrame:
    """One row per input row: key, host, path, rule, verdict.

    The longest rule that fits decides; without one, hosts on the block list and their subdomains are blocked and all others
    allowed. A null url, or one without ``://``, has empty host and path and is allowed. Only key and url are read; repeated
    rows are judged alike, empty tables give no rows.
    """
    blocked = BLOCKED_HOSTS if blocked_hosts is None else blocked_hosts
    entries = list(RULES if rules is None else rules) + [Entry("block", h, "", False) for h in blocked]
    name = ship(pages.sparkSession, entries)
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    address = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("id"),
                        lower_ascii(F.regexp_extract(address, parts, 1)).alias("host"),
                        F.regexp_extract(address, parts, 2).alias("path"))
    return rows.mapInArrow(_judge(name), "id long, host string, path string, rule string, verdict string") \
        .withColumnRenamed("id", key)
