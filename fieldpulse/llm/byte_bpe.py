"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Bytes of a pre-token form a linked list. For every merge rank a bucket holds the positions where a pair of that rank may
start; a two-level bitmap over the ranks finds the first filled bucket by find-first-set. Entries that earlier merges made
stale are skipped when they are taken out. The work is n log n, so very long pre-tokens need no special case.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.words import slices

KEPT_PIECES = 400_000
_LOADED: dict[tuple[int, str], "Codec"] = {}


class Codec:
    """Encoder and decoder for one set of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT_PIECES):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pairs = [-1] * 65536  # ranks of two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.find = regex.compile(pattern).findall
        self.words = [0] * ((max(ranks.values(), default=0) >> 8) + 1)  # all zero between two merges
        self.longest = max(map(len, ranks), default=0)
        self.kept = kept
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is merged, the leftmost first, until no pair has a rank.

        The queue: ``buckets`` hold positions by rank, in heap order; a filled bucket is a bit in a word of 256 ranks, a
        filled word a bit of ``top``. It is written out in the loop because calls would cost more than its work.
        """
        ranks, longest, words, n = self.ranks, self.longest, self.words, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        rank_of = ranks.get
        after = list(range(1, n + 2))  # end of the token that starts here
        before = list(range(-1, n))  # start of the token on its left
        pairs = self.pairs
        current = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # rank of the pair that starts here
        buckets: dict[int, list[int]] = {}
        top = 0
        for i, rank in enumerate(current):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        current += (-1, -1)
        while top:
            at = (top & -top).bit_length() - 1  # find first set, twice
            word = words[at]
            rank = at << 8 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[at] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if current[i] != rank:
                continue  # stale
            middle = after[i]
            end = after[i] = after[middle]
            current[middle] = -1
            left = before[i]
            if end < n:
                before[end] = i
                stop = after[end]
                new = rank_of(piece[i:stop], -1) if stop - i <= longest else -1
            else:
                new = -1
            current[i] = new
            start = i
            while True:  # the new pair that starts here, then the one on its left
                if new >= 0:
                    if new in buckets:
                        heappush(buckets[new], start)
                    else:
                        buckets[new] = [start]
                        words[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
                if start != i or left < 0:
                    break
                new = rank_of(piece[left:end], -1) if end - left <= longest else -1
                if current[left] == new:
                    break
                current[left] = new
                start = left
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. Ids of short pieces are kept in two generations of bounded size."""
        pieces = self.find(text)
        out = list(map(self.young.get, pieces))
        if None in out:
            for at, ids in enumerate(out):
                if ids is None:
                    out[at] = self.piece_ids(pieces[at])
        return np.frombuffer(b"".join(out), "<i4")

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a piece that the young generation does not hold."""
        ids = self.young.get(piece) or self.old.get(piece)
        if ids is None:
            ids = array("i", self.merge(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self.young) >= self.kept:
                self.young, self.old = {}, self.young
            self.young[piece] = ids
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def codec(content: bytes, pattern: str) -> Codec:
    """One codec per Python worker; its memory of pieces is bounded and serves all tasks of the worker."""
    name = (hash(content), pattern)
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Codec(read_ranks(content), pattern)
    return _LOADED[name]


def _encode(content: bytes, pattern: str, also: list[str], decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(content, pattern)
        for whole in batches:
            for batch in slices(whole, "__text"):
                lists = [coder.encode(t.as_py() or "") for t in batch.column("__text")]
                edges = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                columns = [*(batch.column(c) for c in also), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))]
                if decoded:
                    columns.append(pa.array([coder.decode(ids.tolist()) for ids in lists], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*also, "ids", *(["bytes"] if decoded else [])])
    return run


def _decode(content: bytes, pattern: str, also: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = codec(content, pattern)
        for batch in batches:
            texts = [decoder.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in batch.column("__ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in also), pa.array(texts, pa.binary())],
                                             names=[*also, "bytes"])
    return run


def _rows(docs: DataFrame, column: str, keep: list[str], name: str) -> DataFrame:
    return docs.select(*keep, F.col(column).alias(name))


def encode(docs: DataFrame, ranks: str, pattern: str, keep: list[str], text: str = "text",
           decoded: bool = False) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array<int>) of every row, without special tokens.

    ``decoded`` adds ``bytes``, what the ids decode to, in the same pass. ``ranks`` is the path of a rank file on the driver;
    its content, a few MB at most, travels with the tasks. Null and empty texts give an empty array. Repeated rows are
    encoded alike; empty tables give no rows; ``keep`` may name neither ``ids`` nor ``bytes``.
    """
    with open(ranks, "rb") as file:
        content = file.read()
    rows = _rows(docs, text, keep, "__text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), "`ids` array<int>",
                        *(["`bytes` binary"] if decoded else [])])
    return rows.mapInArrow(_encode(content, pattern, keep, decoded), schema)


def decode(encoded: DataFrame, ranks: str, pattern: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``bytes`` (binary) of every row. Null and empty arrays give no bytes; unknown ids raise."""
    with open(ranks, "rb") as file:
        content = file.read()
    rows = _rows(encoded, ids, keep, "__ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), "`bytes` binary"])
    return rows.mapInArrow(_decode(content, pattern, keep), schema)
