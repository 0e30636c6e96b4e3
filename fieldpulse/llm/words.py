"""Words and word sequences of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a run of bytes outside space and tab to carriage return; UTF-8 keeps those bytes out of longer characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 4 << 20

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))
_33 = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over all output bits."""
    h = h ^ (h >> _33)
    h *= _A
    h ^= h >> _33
    h *= _B
    h ^= h >> _33
    return h


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data``, and the first word of each text in ``first`` (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits per word: without collisions up to eight bytes, well mixed beyond."""
        size = self.ends - self.starts
        loads = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        h = mix((size.astype(np.uint64) * _C) ^ (loads[self.starts] & _MASK[np.minimum(size, 8)]))
        at, rest = 8, np.flatnonzero(size > 8)
        while len(rest):
            part = loads[self.starts[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]
            h[rest] = mix((h[rest] * _C) ^ part)
            at += 8
            rest = rest[size[rest] > at]
        return h

    def text(self, n: int) -> bytes:
        """Words of text number n, joined by one space."""
        a, b = self.first[n], self.first[n + 1]
        return b" ".join(bytes(self.data[s:e]) for s, e in zip(self.starts[a:b], self.ends[a:b]))


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of an array of strings; null counts as empty. ``lower`` maps A-Z to a-z only."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    buffers = texts.buffers()
    edges = np.frombuffer(buffers[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) \
        if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(buffers[2], np.uint8)[edges[0]:edges[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    data = np.zeros(len(raw) + 16, np.uint8)
    data[:len(raw)] = _LOWER[raw] if lower else raw
    inside = ~_IS_BLANK[raw]
    opening, closing = inside.copy(), inside.copy()
    opening[1:] &= ~inside[:-1]
    closing[:-1] &= ~inside[1:]
    cuts = edges[:-1][edges[:-1] < len(raw)]
    opening[cuts] = inside[cuts]
    cuts = edges[1:][edges[1:] > 0] - 1
    closing[cuts] = inside[cuts]
    starts = np.flatnonzero(opening)
    return Words(data, starts, np.flatnonzero(closing) + 1, np.searchsorted(starts, edges))


def sequences(hashes: np.ndarray, size: int) -> np.ndarray:
    """64 bits for each run of ``size`` consecutive hashes, in place of its first."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix(h * _C + hashes[k:k + n])
    return h


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece stay near ``limit`` bytes; one text is never cut."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
