"""Bounded samples of labelled documents, and term arithmetic shared by the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, most: int) -> DataFrame:
    """(doc_id, y, text): at most ``most`` labelled rows, drawn by a hash of the id.

    ``labels`` has doc_id and y; only labels 0 and 1 with ``learn`` true count. The drawn
    labels are bounded by ``most``, so they are broadcast to the documents. An id that stands
    for several texts gives the least of them, so repeated ids do not exceed the bound.
    """
    drawn = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y")).filter(learn & F.col("y").isin(0, 1))
    drawn = drawn.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def unique_counts(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, count) of distinct pairs, in order of doc and term."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))) if len(doc) else np.empty(0, np.int64)
    return doc[new], term[new], np.diff(np.append(new, len(doc)))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... start[i] + count[i] - 1 for every i, joined."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


Batches = Iterator[pa.RecordBatch]
