"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are at most ``SAMPLE`` labelled documents, toxic and clean ones alike, as vectors
over all their lower-cased words. A word weighs (1 + log count) * idf * relevance. Relevance
is how far the word's share of toxic examples lies above the share of all examples, smoothed
by ``PRIOR`` examples, and at least ``FLOOR``: it turns the angles towards words that tell
the labels apart, and no word of any example is left out. Words that no example has carry no
weight.

The inverted index lists, per word, its examples in blocks of ``BLOCK`` neighbouring rows,
with the largest weight in each block. A query first adds up these maxima, which bounds the
cosine of every block; it reads the postings of the best blocks, takes its k-th best cosine,
and then reads those of the blocks whose bound reaches that cosine. The others cannot hold a
neighbour, so the neighbours are exact. Their votes are weighted by nearness and mapped to a
probability by an isotonic fit on leave-one-out votes. The neighbours' ids are the evidence.
"""

from __future__ import annotations

import hashlib
import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm._labels import Batches, labelled_sample, ranges, unique_counts
from folioflow.llm._text import NOT_ALNUM, Words, as_long, chunks

SAMPLE = 3_000
PRIOR, FLOOR = 4, 0.02
BLOCK = 256
#: Blocks that a query reads before its bounds are used.
FIRST_BLOCKS = 2
NEIGHBOURS = 15
THRESHOLD = 0.7
#: Cosines that differ by less are ties.
TIE = 1e-9


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, word hash, count) of a chunk, by document."""
    w = Words(data, offsets, NOT_ALNUM, lower=True)
    return unique_counts(w.doc, w.hashes())


def _vectors(batches: Batches) -> Batches:
    for rows, data, offsets in chunks(batches):
        doc, term, count = terms(data, offsets)
        cut = pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32))
        yield pa.record_batch({"doc_id": rows.column("doc_id"), "y": rows.column("y"), "term": pa.ListArray.from_arrays(cut, as_long(term)), "count": pa.ListArray.from_arrays(cut, pa.array(count.astype(np.int32)))})


class Index(NamedTuple):
    #: Sorted word hashes and their weight, idf * relevance.
    vocabulary: np.ndarray
    weight: np.ndarray
    #: Blocks of word t: entries cut[t] .. cut[t + 1], each with its block and largest weight.
    cut: np.ndarray
    block: np.ndarray
    top: np.ndarray
    #: Postings of entry e: posting[e] .. posting[e + 1], each an example's row and weight.
    posting: np.ndarray
    row: np.ndarray
    value: np.ndarray
    y: np.ndarray
    ids: np.ndarray
    #: Probability for documents without any known word, and the isotonic levels for the others.
    without: float
    steps: tuple[np.ndarray, np.ndarray]


def make_index(doc: np.ndarray, term: np.ndarray, value: np.ndarray, vocabulary: np.ndarray, weight: np.ndarray, y: np.ndarray, ids: np.ndarray, without: float) -> Index:
    """Index of unit vectors given as (doc, term position, value)."""
    order = np.lexsort((doc, term))
    doc, term, value = doc[order], term[order], value[order]
    block = doc // BLOCK
    new = np.ones(len(doc), bool)
    new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    top = np.maximum.reduceat(value, at) if len(at) else np.zeros(0)
    cut = np.searchsorted(term[at], np.arange(len(vocabulary) + 1)).astype(np.int32)
    return Index(vocabulary, weight, cut, block[at].astype(np.int32), top, np.append(at, len(doc)).astype(np.int32), doc.astype(np.int32), value, y, ids, without, (np.zeros(0), np.zeros(0)))


def unit(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(doc, value**2, n))
    return value / np.maximum(norm, 1e-12)[doc]


def nearest(term: np.ndarray, value: np.ndarray, index: Index, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and rows of the at most ``k`` nearest examples with a common word, best first, ties to the smaller id.

    The query is a unit vector given by positions in the vocabulary; row ``skip`` takes no part.
    """
    n = index.cut[term + 1] - index.cut[term]
    entry, weight = ranges(index.cut[term], n), np.repeat(value, n)
    block = index.block[entry]
    blocks = (len(index.y) + BLOCK - 1) // BLOCK
    bound = np.bincount(block, weight * index.top[entry], blocks)
    score = np.zeros(len(index.y))

    def read(wanted: np.ndarray) -> None:
        pick = wanted[block]
        e, w = entry[pick], weight[pick]
        m = index.posting[e + 1] - index.posting[e]
        p = ranges(index.posting[e], m)
        np.add(score, np.bincount(index.row[p], np.repeat(w, m) * index.value[p], len(score)), out=score)
        if skip >= 0:
            score[skip] = 0

    first = np.zeros(blocks, bool)
    first[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
    read(first)
    worst = -np.partition(-score, k - 1)[k - 1] if len(score) >= k else 0.0
    more = ~first & (bound > 0) & (bound >= worst - TIE)
    if more.any():
        read(more)
    got = np.flatnonzero(score > 0)
    if len(got) > k:
        worst = -np.partition(-score[got], k - 1)[k - 1]
        got = got[score[got] >= worst - TIE]
    got = got[np.lexsort((index.ids[got], -np.round(score[got] / TIE)))][:k]
    return score[got], got


def vote(cosine: np.ndarray, row: np.ndarray, y: np.ndarray) -> float:
    """Toxic weight of the neighbours: each counts cosine^2 / (distance + 0.05), against one clean vote of 1."""
    c = np.clip(cosine, 0, 1)
    weight = c**2 / (1.05 - c)
    return float((weight * y[row]).sum() / (weight.sum() + 1))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean x and smoothed level of each block of the non-decreasing least-squares fit.

    Between blocks the probability runs straight from one level to the next.
    """
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            total, s, n = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += s
            blocks[-1][2] += n
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


def relevance(toxic: np.ndarray, df: np.ndarray, share: float) -> np.ndarray:
    lift = (toxic + share * PRIOR) / (df + PRIOR) - share
    return np.maximum(lift / max(1 - share, 1e-9), FLOOR)


def fit(table: pa.Table) -> Index | None:
    """The index of examples (doc_id, y, term, count); copies with one label count once, under their smallest id."""
    if not table.num_rows:
        return None
    table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    lists, counts = (table.column(c).combine_chunks() for c in ("term", "count"))
    first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    term, count = lists.flatten().to_numpy().view(np.uint64), counts.flatten().to_numpy()
    y, ids = table.column("y").to_numpy().astype(float), table.column("doc_id").to_numpy()
    names = {}
    for i, (a, b) in enumerate(zip(first, first[1:])):
        names.setdefault((y[i], hashlib.blake2b(term[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest()), i)
    keep = np.array(sorted(names.values()))
    size = first[keep + 1] - first[keep]
    at = ranges(first[keep], size)
    term, count, y, ids = term[at], count[at], y[keep], ids[keep]
    del table, lists, counts, at
    n, share, doc = len(y), float(y.mean()), np.repeat(np.arange(len(keep), dtype=np.int32), size)
    vocabulary, term = np.unique(term, return_inverse=True)
    term = term.astype(np.int32)
    df, toxic = np.bincount(term, minlength=len(vocabulary)), np.bincount(term, y[doc], len(vocabulary))
    weight = (np.log((n + 1) / (df + 1)) + 1) * relevance(toxic, df, share)
    # Stored as single precision; bounds and cosines are both taken from the stored weights.
    value = unit(doc, (1 + np.log(count)) * weight[term], n).astype(np.float32)
    del count
    some = np.bincount(doc, minlength=n) > 0
    without = (y[~some].sum() + 0.5) / ((~some).sum() + 1) if (~some).any() else (y.sum() + 0.5) / (n + 1)
    # Examples with the same heaviest word stand together, so that block maxima are tight.
    cut = np.searchsorted(doc, np.arange(n + 1))
    lead = np.array([term[a + value[a:b].argmax()] if a < b else -1 for a, b in zip(cut, cut[1:])])
    order = np.lexsort((ids, lead))
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    y, ids = y[order], ids[order]
    index = make_index(place[doc], term, value, vocabulary, weight, y, ids, float(without))
    drawn = np.flatnonzero(some)
    left_out = [vote(*nearest(term[cut[i] : cut[i + 1]], value[cut[i] : cut[i + 1]], index, NEIGHBOURS, int(place[i])), y) for i in drawn.tolist()]
    return index._replace(steps=isotonic(np.array(left_out), y[place[drawn]])) if len(drawn) else index


def _fitted(batches: Batches) -> Batches:
    """The pickled index of all examples, which stand in one row."""
    for batch in batches:
        for rows in batch.column("examples"):
            table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(rows.values)])
            index = fit(table)
            yield pa.record_batch({"index": pa.array([pickle.dumps(index and tuple(index))], pa.binary())})


def build(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Index | None:
    """The index of a sample of examples. It is fitted on an executor, as the driver's memory would keep what that takes."""
    found = labelled_sample(docs, labels, learn, sample).mapInArrow(_vectors, "doc_id long, y int, term array<long>, count array<int>")
    one = found.agg(F.collect_list(F.struct("doc_id", "y", "term", "count")).alias("examples"))
    index = pickle.loads(one.mapInArrow(_fitted, "index binary").collect()[0]["index"])
    return index and Index(*index)


def rate(data: np.ndarray, offsets: np.ndarray, index: Index | None) -> tuple[np.ndarray, list[list[int]]]:
    """Scores and evidence of a chunk's documents."""
    n = len(offsets) - 1
    score, near = np.full(n, 0.5 if index is None else index.without), [[]] * n
    if index is not None and len(index.steps[0]):
        doc, term, count = terms(data, offsets)
        spot = np.minimum(np.searchsorted(index.vocabulary, term), len(index.vocabulary) - 1)
        known = index.vocabulary[spot] == term
        doc, spot, count = doc[known], spot[known], count[known]
        value = unit(doc, (1 + np.log(count)) * index.weight[spot], n)
        cut = np.searchsorted(doc, np.arange(n + 1))
        for i in range(n):
            if cut[i] < cut[i + 1]:
                cosine, row = nearest(spot[cut[i] : cut[i + 1]], value[cut[i] : cut[i + 1]], index, NEIGHBOURS)
                score[i] = np.interp(vote(cosine, row, index.y), *index.steps)
                near[i] = index.ids[row[:3]].tolist()
    return score, near


def _score(batches: Batches, index: Index | None) -> Batches:
    for rows, data, offsets in chunks(batches):
        score, near = rate(data, offsets, index)
        yield pa.record_batch({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "score": pa.array(score), "evidence": pa.array(near, pa.list_(pa.int64()))})


def _keep(batches: Batches, text: str, index: Index | None, threshold: float) -> Batches:
    for rows, data, offsets in chunks(batches, text):
        yield rows.filter(pa.array(rate(data, offsets, index)[0] < threshold))


def clean(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``; no row is moved."""
    index = docs.sparkSession.sparkContext.broadcast(build(docs, labels, ~held_out, sample))
    return docs.mapInArrow(lambda b: _keep(b, "text", index.value, threshold), docs.schema)


def score(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and y (0 or 1). Labels are learned from where ``held_out``, an
    expression over doc_id, is false; a null there is neither learned from nor held out. The
    score reads nothing but the text. Null, empty and wordless texts, and texts without any
    word of the examples, get the share of toxic rows among wordless examples, or among all
    where there is none; without usable labels every score is 0.5. ``evidence`` has the ids of
    the three nearest examples; equal cosines go to the smaller id. An id with several texts
    teaches with the least of them, one with both labels teaches both. Repeated rows repeat;
    labelled copies with one label count once. Extra columns are ignored.
    """
    index = docs.sparkSession.sparkContext.broadcast(build(docs, labels, ~held_out, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = rows.mapInArrow(lambda b: _score(b, index.value), "doc_id long, held_out boolean, score double, evidence array<long>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
