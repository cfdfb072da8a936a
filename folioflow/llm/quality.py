"""Quality scores from a factorisation machine.

A document's features are its words, hashed to ``BUCKETS`` weights, statistics of its
structure (character classes, word lengths, repetition of words and lines, line shape) and
metadata that the text carries itself (its size). The machine adds to a linear score the
products of all feature pairs, with rank-``RANK`` factors, in time linear in the features:
sum over pairs <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2.

It is fitted by Adagrad on at most ``SAMPLE`` labelled rows, whose features (not texts)
reach the driver. Every document is scored, whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm._labels import Batches, labelled_sample, unique_counts
from folioflow.llm._text import NEWLINE, NOT_ALNUM, WHITE, Words, chunks, mix

SAMPLE = 8_000
BUCKETS = 1 << 15
RANK = 8
EPOCHS = 12
RATE = 0.08
DECAY = 2e-5

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[128:] = 4
_CLASS[[9, 11, 12, 13, 32]] = 5
_CLASS[10] = 6
for _b in b".,;:":
    _CLASS[_b] = 7
for _b in b"!?":
    _CLASS[_b] = 8
for _b in b"'\"()-":
    _CLASS[_b] = 9
for _b in b"|":
    _CLASS[_b] = 10
CLASSES = 11
STATS = CLASSES + 12


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return run[first[1:]] - run[first[:-1]]


def _repeats(h: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct items, items equal to the one before, and the largest count, per document."""
    doc = w.doc
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    who, _, times = unique_counts(doc, h)
    n = len(w.count)
    top = np.zeros(n)
    np.maximum.at(top, who, times)
    return np.bincount(who, minlength=n), _sum(again, w.first), top


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word features (doc, bucket, value) and the (documents, STATS) structure statistics."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)
    doc = np.repeat(np.arange(n), size)
    table = np.bincount(doc * 16 + _CLASS[data], minlength=n * 16).reshape(n, 16)[:, :CLASSES] / some[:, None]
    w = Words(data, offsets, WHITE)
    h, count = w.hashes(), np.maximum(w.count, 1)
    distinct, again, top = _repeats(h, w)
    length = (w.end - w.start).astype(float)
    mean = _sum(length, w.first) / count
    lines = Words(data, offsets, NEWLINE)
    many = np.maximum(lines.count, 1)
    line_distinct, line_again, _ = _repeats(lines.hashes(), lines)
    alnum = ~NOT_ALNUM[data]
    ends = ~alnum[w.end - 1] if len(w.end) else np.empty(0, bool)
    stats = np.column_stack([
        table, np.log1p(size), np.log1p(w.count), mean, np.sqrt(np.maximum(_sum(length**2, w.first) / count - mean**2, 0)), distinct / count, again / count, top / count,
        line_distinct / many, line_again / many, np.log1p(lines.count), _sum(ends, w.first) / count, _sum(length <= 1, w.first) / count,
    ])
    v = Words(data, offsets, NOT_ALNUM, lower=True)
    who, bucket, times = unique_counts(v.doc, (mix(v.hashes()) >> np.uint64(49)).astype(np.int64))
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(who, value**2, n))
    return who, bucket, value / np.maximum(norm[who], 1e-9), stats


class Machine:
    """Weights of hashed words and of standardised statistics, and their factors."""

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(5))
        self.bias, self.linear = 0.0, np.zeros(BUCKETS + STATS)
        self.factor = rng.normal(0, 0.02, (BUCKETS + STATS, RANK))
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)

    def rows(self, who: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features of a chunk as (doc, feature, value), by document."""
        n = len(stats)
        z = np.clip((stats - self.mean) / self.scale, -6, 6) * 0.5
        doc = np.concatenate((who, np.repeat(np.arange(n), STATS)))
        feature = np.concatenate((bucket, np.tile(BUCKETS + np.arange(STATS), n)))
        x = np.concatenate((value, z.ravel()))
        order = np.argsort(doc, kind="stable")
        return doc[order], feature[order], x[order]

    def score(self, doc: np.ndarray, feature: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.searchsorted(doc, np.arange(n))
        vx = self.factor[feature] * x[:, None]
        total = np.add.reduceat(vx, first, axis=0)
        square = np.add.reduceat((vx**2).sum(1), first)
        return self.bias + np.add.reduceat(self.linear[feature] * x, first) + 0.5 * ((total**2).sum(1) - square), total

    def fit(self, who: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, y: np.ndarray) -> None:
        n = len(y)
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        share = np.clip(y.mean(), 0.5 / n, 1 - 0.5 / n)
        self.bias = float(np.log(share / (1 - share)))
        doc, feature, x = self.rows(who, bucket, value, stats)
        first = np.searchsorted(doc, np.arange(n + 1))
        rng = np.random.Generator(np.random.PCG64(6))
        seen_linear, seen_factor, seen_bias = np.full(len(self.linear), 1e-6), np.full(self.factor.shape, 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for s in range(0, n, 64):
                pick = order[s : s + 64]
                length = first[pick + 1] - first[pick]
                at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[pick], length)
                local = np.repeat(np.arange(len(pick)), length)
                f, v = feature[at], x[at]
                raw, total = self.score(local, f, v, len(pick))
                g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]
                used, where = np.unique(f, return_inverse=True)
                gl = np.bincount(where, g[local] * v, len(used)) + DECAY * self.linear[used]
                per = (g[local] * v)[:, None] * (total[local] - self.factor[f] * v[:, None])
                gf = np.stack([np.bincount(where, per[:, r], len(used)) for r in range(RANK)], 1) + DECAY * self.factor[used]
                seen_linear[used] += gl**2
                seen_factor[used] += gf**2
                seen_bias += g.sum() ** 2
                self.linear[used] -= RATE * gl / np.sqrt(seen_linear[used])
                self.factor[used] -= RATE * 0.5 * gf / np.sqrt(seen_factor[used])
                self.bias -= RATE * g.sum() / np.sqrt(seen_bias)


def _extract(batches: Batches) -> Batches:
    for rows, data, offsets in chunks(batches):
        who, bucket, value, stats = features(data, offsets)
        cut = pa.array(np.searchsorted(who, np.arange(len(stats) + 1)).astype(np.int32))
        yield pa.record_batch({
            "doc_id": rows.column("doc_id"), "y": rows.column("y"), "bucket": pa.ListArray.from_arrays(cut, pa.array(bucket.astype(np.int32))), "value": pa.ListArray.from_arrays(cut, pa.array(value.astype(np.float32))),
            "stats": pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), STATS).cast(pa.list_(pa.float64())),
        })


def _score(batches: Batches, machine: Machine | None) -> Batches:
    for rows, data, offsets in chunks(batches):
        n = rows.num_rows
        score = np.full(n, 0.5)
        if machine is not None:
            raw, _ = machine.score(*machine.rows(*features(data, offsets)), n)
            score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        yield pa.record_batch({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "score": pa.array(score)})


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Machine | None:
    got = labelled_sample(docs, labels, learn, sample).mapInArrow(_extract, "doc_id long, y int, bucket array<int>, value array<float>, stats array<double>").toArrow()
    if not got.num_rows:
        return None
    # One order of the rows, so that every fit gives the same weights.
    got = got.combine_chunks().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy().astype(float)
    bucket = got.column("bucket").combine_chunks()
    who = np.repeat(np.arange(len(y)), bucket.value_lengths().to_numpy())
    machine = Machine()
    machine.fit(who, bucket.flatten().to_numpy().astype(np.int64), got.column("value").combine_chunks().flatten().to_numpy().astype(float), got.column("stats").combine_chunks().flatten().to_numpy().reshape(len(y), STATS), y)
    return machine


def score(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and y (0 or 1). Labels are learned from where ``held_out``, an
    expression over doc_id, is false; a null there is neither learned from nor held out. The
    score reads nothing but the text. Null and empty texts are scored on their statistics
    alone. Without usable labels every score is 0.5. Repeated rows repeat; a document with
    both labels teaches both. Extra columns are ignored.
    """
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~held_out, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(lambda b: _score(b, machine.value), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
