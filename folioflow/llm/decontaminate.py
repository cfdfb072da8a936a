"""Benchmark leaks in documents, found with spaced seeds and verified with substitutions.

A mask reads some positions of a 13-word stretch and ignores the others, so a word replaced
at an ignored position does not hide the overlap. ``MASKS`` together hit every stretch of 13
words or more of which 80 % agree: one of 26 or more has a part of 13 to 25 that agrees as
well, and of those every placement of the substitutions is hit. Test hashes are broadcast in blocks of bounded size
(``BLOCK_WORDS`` words of items a pass); a larger benchmark takes more passes. Each hit
fixes an alignment of item and document, which is then compared word by word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._spark import durable
from folioflow.llm._text import NOT_ALNUM, Words, chunks, mix, raw

#: Word positions that a seed reads.
MASKS = ((0, 1, 2, 4, 5, 6, 7), (0, 1, 3, 6, 8, 9, 10), (0, 1, 2, 4, 5, 8, 9), (0, 1, 2, 4, 10, 12, 13), (0, 1, 3, 4, 8, 10, 11), (0, 1, 3, 5, 6, 7, 8))
OVERLAP = 13
AGREE = 0.8
SHORTEST = 5
BLOCK_WORDS = 2_000_000
SCHEMA = "doc_id long, item_id long, start int, length int, matched int, item_words int"


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks for a whole item of ``n`` words: whichever n // 5 of them are replaced, one reads none of those.

    With e replacements, some e + 1 of 2 e + 1 parts are untouched.
    """
    e = n // 5
    parts = [range(n * i // (2 * e + 1), n * (i + 1) // (2 * e + 1)) for i in range(2 * e + 1)]
    return [tuple(o for part in some for o in part) for some in combinations(parts, e + 1)]


class Index:
    """Seed hashes of some items, sorted, with a bitmap that settles most look-ups."""

    def __init__(self, ids: np.ndarray, h: np.ndarray, first: np.ndarray):
        self.ids, self.h, self.first = ids, h, first
        self.count = np.diff(first)
        keys, item, at = [], [], []
        doc = np.repeat(np.arange(len(ids)), self.count)
        place = np.arange(len(h)) - first[:-1][doc]
        for m, mask in enumerate(MASKS):
            ok = (place + mask[-1] < self.count[doc]) & (self.count[doc] >= OVERLAP)
            keys.append(seed(h, np.flatnonzero(ok), mask, m + 1))
            item.append(doc[ok])
            at.append(place[ok])
        # Items too short for the masks count only as a whole.
        self.short = sorted(set(self.count[(self.count >= SHORTEST) & (self.count < OVERLAP)].tolist()))
        for n in self.short:
            i = np.flatnonzero(self.count == n)
            for m, mask in enumerate(short_masks(n)):
                keys.append(seed(h, first[i], mask, 100 * n + m))
                item.append(i)
                at.append(np.zeros(len(i), np.int64))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.at = key[order], np.concatenate(item)[order], np.concatenate(at)[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.key >> np.uint64(42)] = True

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (position in ``key``, entry of the index) with equal hashes."""
        at = np.flatnonzero(self.seen[key >> np.uint64(42)])
        lo, hi = np.searchsorted(self.key, key[at], "left"), np.searchsorted(self.key, key[at], "right")
        n = hi - lo
        entry = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.repeat(at, n), entry


def seed(h: np.ndarray, at: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    key = np.full(len(at), salt, np.uint64)
    for offset in mask:
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[at + offset]
    return mix(key)


def overlap(same: np.ndarray, whole: int) -> tuple[int, int, int] | None:
    """(start, length, matched) of the best stretch of an alignment, or None.

    Of all stretches of at least min(OVERLAP, whole) words the one with the most matches net
    of four times its mismatches is taken; that is negative exactly where fewer than AGREE of
    the words agree.
    """
    need = min(OVERLAP, whole)
    if len(same) < need:
        return None
    gain = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))
    net = gain[need:] - np.minimum.accumulate(gain[: len(gain) - need])
    end = int(np.argmax(net)) + need
    if net[end - need] < 0:
        return None
    start = int(np.flatnonzero(gain[: end - need + 1] == gain[end] - net[end - need])[-1])
    return start, end - start, int(same[start:end].sum())


def _leaks(data: np.ndarray, offsets: np.ndarray, index: Index) -> dict[tuple[int, int], tuple[int, ...]]:
    """(document, item) -> (matched, -start, length) of the best overlap, for a chunk."""
    w = Words(data, offsets, NOT_ALNUM, lower=True)
    h, doc, first = w.hashes(), w.doc, w.first
    stop = first[1:][doc]
    place, diagonal, item = [], [], []
    for m, mask in enumerate(MASKS):
        at = np.flatnonzero(np.arange(len(h)) + mask[-1] < stop)
        hit, entry = index.find(seed(h, at, mask, m + 1))
        place.append(doc[at[hit]])
        diagonal.append(at[hit] - index.at[entry])
        item.append(index.item[entry])
    for n in index.short:
        at = np.flatnonzero(np.arange(len(h)) + n <= stop)
        for m, mask in enumerate(short_masks(n)):
            hit, entry = index.find(seed(h, at, mask, 100 * n + m))
            place.append(doc[at[hit]])
            diagonal.append(at[hit])
            item.append(index.item[entry])
    triples = np.unique(np.stack([np.concatenate(place), np.concatenate(item), np.concatenate(diagonal)], 1), axis=0)
    best: dict[tuple[int, int], tuple[int, ...]] = {}
    for d, i, o in triples.tolist():
        lo, hi = max(o, int(first[d])), min(o + int(index.count[i]), int(first[d + 1]))
        same = h[lo:hi] == index.h[index.first[i] + lo - o : index.first[i] + hi - o]
        found = overlap(same, int(index.count[i]))
        if found is not None:
            s, n, matched = found
            row = (matched, -(lo + s - int(first[d])), n)
            best[d, i] = max(best.get((d, i), row), row)
    return best


def _keep(batches: Iterator[pa.RecordBatch], text: str, index: Index) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches, text):
        keep = np.ones(rows.num_rows, bool)
        keep[[d for d, _ in _leaks(data, offsets, index)]] = False
        yield rows.filter(pa.array(keep))


_MADE: dict[str, Index] = {}


def _index(shared: tuple) -> Index:
    """The index of a broadcast block, built once in each worker process; only the last one is kept."""
    name, *held = shared
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Index(*held)
    return _MADE[name]


def _scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches):
        best = _leaks(data, offsets, index)
        if best:
            ids = rows.column("doc_id").take(pa.array([d for d, _ in best]))
            got = list(best.values())
            i = np.array([i for _, i in best])
            yield pa.record_batch({
                "doc_id": ids, "item_id": pa.array(index.ids[i], pa.int64()), "start": pa.array([-s for _, s, _ in got], pa.int32()), "length": pa.array([n for _, _, n in got], pa.int32()),
                "matched": pa.array([m for m, _, _ in got], pa.int32()), "item_words": pa.array(index.count[i].astype(np.int32)),
            })


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, start, length, matched, item_words): one row per document row and leaked item.

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A document
    leaks an item if some alignment of the two has a stretch of at least 13 words, or of the
    whole item where that is shorter, in which 80 % of the words agree. Items of under 5 words
    prove nothing and never match. ``start`` and
    ``length`` are words of the document. Null and empty texts or items, and items with a null
    id, match nothing; documents with a null id are reported with it. Repeated rows repeat.
    Extra columns are ignored. Without documents or items the result is empty.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = [source.mapInArrow(lambda b, s=shared: _scan(b, _index(s.value)), SCHEMA) for shared in _blocks(benchmark, item_col)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no item; no row is moved."""
    for n, shared in enumerate(_blocks(benchmark, item_col)):
        # Written between blocks, so that no stage holds two of them.
        docs = durable(docs) if n else docs
        docs = docs.mapInArrow(lambda b, s=shared: _keep(b, text_col, _index(s.value)), docs.schema)
    return docs


def _blocks(benchmark: DataFrame, item_col: str) -> list:
    """Broadcast ids, word hashes and offsets of the items, at most about BLOCK_WORDS words each."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    # A word takes two characters or more with what separates it.
    size = (items.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // 2
    blocks = int(size // BLOCK_WORDS) + 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = []
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).orderBy("item_id", "text").select("item_id", "text").toArrow()
        if rows.num_rows:
            data, offsets = raw(rows.column("text"))
            w = Words(data, offsets, NOT_ALNUM, lower=True)
            out.append(benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows.column("item_id").to_numpy(), w.hashes(), w.first)))
    return out
