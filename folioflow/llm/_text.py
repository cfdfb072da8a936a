"""Vectorised token arithmetic over Arrow string columns.

A *chunk* is the concatenated UTF-8 bytes of some whole documents with their offsets. All
helpers work on chunks, so the cost per document is a few numpy passes and no Python loop
over words. Word classes are decided on bytes, which is exact for UTF-8 because every byte
of a non-ASCII character is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for bytes that separate words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x80:] = False
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, from a table that grows by doubling."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of at most ``limit`` bytes, or of one longer document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = raw(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


class Words:
    """Words of a chunk: start and end bytes, 64-bit hashes, and where each document's begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE, lower: bool = False):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~separator[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        before &= ~edge[:n]
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.inside = inside
        #: Word w of document d: first[d] <= w < first[d + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        at = np.arange(len(self.data), dtype=np.int32 if len(self.data) < 2**31 else np.int64)
        mark = np.zeros(len(at), at.dtype)
        mark[self.start] = self.start
        at -= np.maximum.accumulate(mark)
        table = powers(1 << 16)
        code = BYTE_CODE[self.data]
        code[~self.inside] = 0
        code *= table[at & 0xFFFF]
        total = np.add.reduceat(code, self.start)
        return mix(total + (self.end - self.start).astype(np.uint64) * BASE)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of items start..end-1 from ``prefix_sums``; equal sequences hash equally anywhere."""
    inverse = powers(int(start.max(initial=0)) + 1, BASE_INVERSE)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * BASE)


def prefix_sums(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=out[1:])
    return out


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))
