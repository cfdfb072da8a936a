"""Exact top-k inner products by the no-random-access algorithm, block by block.

For a query, dimension j is a list of candidates by falling contribution: from the largest
component down where the query's component is positive, from the smallest up where it is
negative. A block of candidates sorts every dimension once; all lists are then read
sequentially, to growing depths. What is unread is bounded by the value last read (upper
bound) and by the list's end (lower bound). Candidates whose upper bound is under the k-th
best score known so far are outsiders; reading stops when few others are left, and their
scores are then resolved exactly. Bounds for all queries and candidates of a block are matrix
products of clipped components, since an unread component is exactly one beyond the last
value read. On dense vectors without structure the bounds cost about as much as the scores
that they save; where components exceed 2^52 they are left out and all scores are resolved.

Candidates stay where they are: bounded sets of queries are broadcast to them, a task keeps
k rows per query over all its candidates, so that later blocks start with a known k-th
score, and only these rows are shuffled. Queries beyond ``QUERY_BYTES`` take another pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm._spark import durable

#: Bytes of queries broadcast for one pass over the candidates.
QUERY_BYTES = 32 << 20
QUERY_ROWS = 512
SUB_ROWS = 2_048
DEPTHS = (0.375, 0.5, 0.625, 0.75, 0.875)
FEW = 0.02
EXACT = 2.0**52


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, short ones padded with zeros."""
    n = lists.value_lengths().to_numpy()
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[row, at] = lists.flatten().to_numpy()
    return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products; Python integers where doubles would not be exact."""
    if len(q) and np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1) >= EXACT:
        top = 2**63 - 1
        return np.array([max(-top - 1, min(top, sum(int(a) * int(b) for a, b in zip(r, s)))) for r, s in zip(q.tolist(), x.tolist())], np.int64)
    return (q * x).sum(1).astype(np.int64)


class Best:
    """The k best candidates of each query, over all blocks offered so far."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.ids, self.k = q, ids, k
        self.score = np.zeros((len(q), k), np.int64)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.known = np.zeros(len(q), np.int64)

    def floor(self) -> np.ndarray:
        """The k-th best score of each query, minus infinity while there are fewer."""
        return np.where(self.known == self.k, self.score[:, -1].astype(float), -math.inf)

    def offer(self, x: np.ndarray, x_ids: np.ndarray) -> None:
        """Take in candidates; one with a query's own id does not count for it."""
        width = max(self.q.shape[1], x.shape[1])
        q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (self.q, x))
        safe = len(q) and len(x) and np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(width, 1) < EXACT
        # By falling norm, so that good scores are known early.
        order = np.argsort(-(x**2).sum(1), kind="stable") if safe else np.arange(len(x))
        for s in range(0, len(x), SUB_ROWS):
            pick = order[s : s + SUB_ROWS]
            c, ids = x[pick], x_ids[pick]
            lists = np.sort(c, axis=0) if safe else None
            for r in range(0, len(q), QUERY_ROWS):
                self._block(q, r, min(r + QUERY_ROWS, len(q)), c, ids, lists)

    def _block(self, all_q: np.ndarray, start: int, stop: int, c: np.ndarray, ids: np.ndarray, lists: np.ndarray | None) -> None:
        q, n, k = all_q[start:stop], len(c), self.k
        alive = self.ids[start:stop, None] != ids[None, :]
        if lists is not None:
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            floor = self.floor()[start:stop]
            for depth in DEPTHS:
                t = int(n * depth)
                if t < 1 or t >= n:
                    continue
                read_down, read_up = lists[n - t], lists[t - 1]
                if np.isinf(floor).any() and n > k:
                    # No k-th score yet: take the k-th largest lower bound among this block.
                    low = up @ np.where(c >= read_down, c, lists[0]).T + down @ np.where(c <= read_up, c, lists[-1]).T
                    low[self.ids[start:stop, None] == ids[None, :]] = -math.inf
                    floor = np.maximum(floor, np.partition(low, n - k, axis=1)[:, n - k])
                high = up @ np.where(c >= read_down, c, read_down).T + down @ np.where(c <= read_up, c, read_up).T
                alive &= high >= floor[:, None]
                if alive.mean() < FEW:
                    break
        qi, ci = np.nonzero(alive)
        for b in range(0, len(qi), 200_000):
            i, j = qi[b : b + 200_000], ci[b : b + 200_000]
            score = exact_scores(q[i], c[j])
            keep = score >= self.floor()[start:stop][i]
            i, j, score = i[keep], j[keep], score[keep]
            rows, first = np.unique(i, return_index=True)
            for r, lo, hi in zip((rows + start).tolist(), first.tolist(), [*first[1:].tolist(), len(i)]):
                have = self.known[r]
                both = np.concatenate((self.score[r, :have], score[lo:hi])), np.concatenate((self.found[r, :have], ids[j[lo:hi]]))
                # ~score orders as -score does, without overflow.
                o = np.lexsort((both[1], ~both[0]))[:k]
                self.score[r, : len(o)], self.found[r, : len(o)], self.known[r] = both[0][o], both[1][o], len(o)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate id, score)."""
        i, j = np.nonzero(np.arange(self.k)[None, :] < self.known[:, None])
        return i, self.found[i, j], self.score[i, j]


def _search(batches: Iterator[pa.RecordBatch], queries: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    lists = queries.column("v").combine_chunks()
    best = Best(_matrix(lists, int(lists.value_lengths().to_numpy().max(initial=0))), queries.column("query_id").to_numpy(), k)
    for batch in batches:
        x = batch.column("v")
        if batch.num_rows:
            best.offer(_matrix(x, int(x.value_lengths().to_numpy().max(initial=0))), batch.column("vec_id").to_numpy())
    row, ids, score = best.rows()
    at = pa.array(row)
    yield pa.record_batch({"query_id": queries.column("query_id").combine_chunks().take(at), "query_row": queries.column("query_row").combine_chunks().take(at), "vec_id": pa.array(ids), "score": pa.array(score)})


def integral(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component, as doubles; null vectors and vectors with a null or non-finite component give null."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def scaled(x: Column) -> Column:
        y = x.cast("double") * factor
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return F.when(vector.isNotNull() & usable, F.transform(vector, scaled))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    ``queries`` has query_id and v, ``candidates`` vec_id and v, an array of doubles with
    integral values. A query meets every candidate with another id; ties go to the smaller
    vec_id; fewer than k candidates give fewer rows. Queries are a stated, small share of the
    rows: each pass broadcasts at most about ``QUERY_BYTES`` of them. Null ids or vectors take no part. Short
    vectors count as padded with zeros. Repeated candidates are found repeatedly; queries
    that repeat id and vector count once, and equal ids with different vectors are ranked
    each on their own. Extra columns are ignored; empty tables give no rows.
    """
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v")).filter("query_id is not null and v is not null").distinct().withColumn("query_row", F.xxhash64("v"))
    c = candidates.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    size = q.agg(F.sum(F.size("v") * 8 + 16).alias("n")).first()["n"] or 0
    passes = max(1, math.ceil(size / QUERY_BYTES))
    q = q.withColumn("turn", F.pmod(F.xxhash64("query_id", "query_row"), F.lit(passes)))
    spark, found = q.sparkSession, []
    for turn in range(passes):
        # A hash deals about QUERY_BYTES to each pass; they are a known share of the queries.
        part = spark.sparkContext.broadcast(q.filter(F.col("turn") == turn).orderBy("query_id", "query_row").select("query_id", "query_row", "v").toArrow().combine_chunks())
        rows = c.mapInArrow(lambda b, part=part: _search(b, part.value, k), "query_id long, query_row long, vec_id long, score long")
        found.append(rows if passes == 1 else durable(rows))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
