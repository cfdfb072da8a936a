"""Removal of repeated word passages by recompression.

Every document's words are parsed by the same rules: short runs of one word become one
symbol, then in each of ``ROUNDS`` rounds all symbols fall into two sides by a hash of their
name, and each adjacent left-right pair becomes one symbol named by its parts. Names are
content hashes, so they are global without a dictionary and the rounds run inside one Arrow
pass instead of one Spark round each: equal passages get equal interior symbols in any
document and on any executor. With each symbol the parse records its *context*, the exact
span of words that decided it, and so its name. A window of 50 words sees the symbols whose
context lies inside it, which is a function of the window's words alone; it picks the one
with the smallest context hash. So equal windows always pick the same symbol, and the hash
of that context is their join key. A window that sees no symbol (long runs of one word) is
its own key. Nothing is lost by this, whatever the text. Words and spans are compared by
hashes: a match is agreement of key and window, 128 bits together.

Neighbouring windows with the same pick form a segment, about one per 18 words. Segments
with equal key and equal words are one variant. If a key has one variant, all its windows
are decided by the variant's smallest document. Only keys with several variants (edges of
repeats, edited copies) are resolved window by window, for one copy of each variant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._spark import durable
from folioflow.llm._text import WHITE, Words, as_long, chunks, mix, prefix_sums, span_hash

WINDOW = 50
ROUNDS = 3
LONG_RUN = 8


def recompress(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Names, start, end and context [left, right) of the symbols of all documents of a chunk.

    ``h`` are word hashes, document d holds words first[d]..first[d+1]-1. A context that
    reaches over a document's edge is given one word more than the document has there.
    """
    n = len(h)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low, high = first[:-1][doc] - 1, first[1:][doc] + 1
    at = np.arange(n)

    # Runs of one word. Up to LONG_RUN they become one symbol; longer ones stay single words.
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    run = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, n))
    start, k = begin[run], length[run]
    keep = new | (k > LONG_RUN)
    at, start, k = at[keep], start[keep], k[keep]
    long = k > LONG_RUN
    deep = long & (at - start >= LONG_RUN)
    names = np.where(long | (k == 1), h[at], mix(h[at] + k.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    end = np.where(long, at + 1, at + k)
    left = np.where(deep, at - LONG_RUN, start - 1)
    right = np.where(deep, at + 1, np.where(long, start + LONG_RUN + 1, end + 1))
    low, high, doc, start = low[at], high[at], doc[at], at

    for r in range(rounds):
        n = len(names)
        if not n:
            break
        side = (mix(names + np.uint64(r * 2 + 1)) >> np.uint64(17)) & np.uint64(1)
        same = np.zeros(n + 1, bool)
        same[1:n] = doc[1:] == doc[:-1]  # same[i]: i - 1 and i stand in one document
        head = np.zeros(n, bool)
        head[:-1] = (side[:-1] == 0) & (side[1:] == 1) & same[1:n]
        tail = np.zeros(n, bool)
        tail[1:] = head[:-1]
        after = np.append(right[1:], 0)
        before = np.append(0, left[:-1])
        new_left = np.where((side == 1) & ~tail, np.where(same[:n], before, low), left)
        new_right = np.where((side == 0), np.where(same[1:], after, high), right)
        i = np.flatnonzero(~tail)
        j = np.minimum(i + 1, n - 1)
        paired = head[i]
        names = np.where(paired, mix(names[i] * np.uint64(0x9E3779B97F4A7C15) + mix(names[j])), names[i])
        end = np.where(paired, end[j], end[i])
        left, right = new_left[i], np.where(paired, right[j], new_right[i])
        start, low, high, doc = start[i], low[i], high[i], doc[i]
    return names, start, end, left, right


def _smallest(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the leftmost smallest value in each [lo, hi), -1 where that is empty."""
    pick = np.full(len(lo), -1)
    width = hi - lo
    table, level = np.arange(len(value)), 0
    while True:
        here = np.flatnonzero((width >= 1 << level) & (width < 2 << level))
        if len(here):
            a, b = table[lo[here]], table[hi[here] - (1 << level)]
            pick[here] = np.where(value[a] <= value[b], a, b)
        if len(width) == 0 or width.max(initial=0) < 2 << level:
            return pick
        a, b = table[: -(1 << level)], table[1 << level :]
        table, level = np.where(value[a] <= value[b], a, b), level + 1


def window_starts(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Global start and document of every window of a chunk."""
    n = np.maximum(np.diff(first) - window + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc], doc


def segments(h: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Document, first window (word in the document), number of windows, key and content hash."""
    s, doc = window_starts(first, window)
    if not len(s):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    _, _, _, left, right = recompress(h, first)
    prefix = prefix_sums(h)
    inner = (left >= 0) & (right <= len(h))
    priority = np.zeros(len(left), np.uint64)
    priority[inner] = span_hash(prefix, left[inner], right[inner])
    n = len(h)
    lo = np.concatenate(([0], np.cumsum(np.bincount(left + 1, minlength=n + 2))))[s + 1]
    hi = np.cumsum(np.bincount(right, minlength=n + 2))[s + window]
    pick = _smallest(priority, lo, np.maximum(hi, lo))
    new = np.ones(len(s), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1]) | (pick[1:] < 0)
    b = np.flatnonzero(new)
    count = np.diff(np.append(b, len(s)))
    content = span_hash(prefix, s[b], s[b] + count - 1 + window)
    key = np.where(pick[b] >= 0, priority[pick[b]], content)
    offset = np.where(pick[b] >= 0, left[pick[b]] - s[b], 0).astype(np.uint64)
    return doc[b], s[b] - first[doc[b]], count, key, mix(content + offset * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64))


def _segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches):
        w = Words(data, offsets, WHITE)
        doc, at, count, key, content = segments(w.hashes(), w.first, window)
        yield pa.record_batch({
            "doc_id": rows.column("doc_id").take(pa.array(doc)), "text_hash": rows.column("text_hash").take(pa.array(doc)),
            "at": pa.array(at.astype(np.int32)), "n": pa.array(count.astype(np.int32)), "key": as_long(key), "content": as_long(content),
        })


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for rows, data, offsets in chunks(batches):
        yield pa.record_batch({"doc_id": rows.column("doc_id"), "text_hash": rows.column("text_hash"), "extra": rows.column("extra"), "packed": pa.array([pack.compress(data[s:e]) for s, e in zip(offsets, offsets[1:])], pa.binary())})


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for doc_id, packed, wanted in zip(batch.column("doc_id"), batch.column("packed"), batch.column("wanted")):
            data = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
            prefix = prefix_sums(Words(data, np.array([0, len(data)]), WHITE).hashes())
            at, n, key, content = (wanted.values.field(f).to_numpy() for f in ("at", "n", "key", "content"))
            which = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            s = at[which].astype(np.int64) + i
            yield pa.record_batch({
                "key": pa.array(key[which]), "content": pa.array(content[which]), "i": pa.array(i.astype(np.int32)),
                "w": as_long(span_hash(prefix, s, s + window)), "m": pa.array(np.full(len(s), doc_id.as_py())),
            })


def _apply(batches: Iterator[pa.RecordBatch], window: int, rejoin: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            n_words, n_removed, texts, spans = [], [], [], []
            for packed, cuts in zip(part.column("packed"), part.column("cuts")):
                data = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
                w = Words(data, np.array([0, len(data)]), WHITE)
                total = len(w.start)
                step = np.zeros(total + 1, np.int64)
                for cut in cuts.as_py() or ():
                    for at, n in [(cut["at"], cut["n"])] if cut["hits"] is None else [(cut["at"] + i, 1) for i in cut["hits"]]:
                        step[at] += 1
                        step[at + n - 1 + window] -= 1
                gone = np.cumsum(step)[:total] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
                kept = np.flatnonzero(~gone)
                raw = data.tobytes()
                if rejoin or gone.any():
                    raw = b" ".join([raw[s:e] for s, e in zip(w.start[kept].tolist(), w.end[kept].tolist())])
                texts.append(raw.decode("utf-8"))
                n_words.append(total)
                n_removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge])
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "extra": part.column("extra"), "kept_text": pa.array(texts, pa.string()),
                "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            })


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = (), rejoin: bool = True) -> DataFrame:
    """(doc_id, text_hash, n_words, n_removed, extra, kept_text, removed) for every row of ``docs``.

    A word goes when some window of ``window`` consecutive words that covers it has the same
    words as a window of a document with a smaller id. Windows are judged on the input. Words
    are separated by white space and compared unchanged; kept words are joined by one space.
    ``removed`` lists word spans [start, end). Null and empty texts have no words. Rows with a
    null id take no part and keep all words. Rows that repeat an id are one document where
    ids are compared, and each is returned. An empty table gives no
    rows. ``text_hash`` tells rows with one id and different texts apart. ``extra`` is a
    struct of the columns named in ``carry``; other columns are ignored. With ``rejoin`` false
    a text that loses nothing stays as it is.
    """
    extra = F.struct(*carry) if carry else F.lit(None).cast("struct<none:int>")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), extra.alias("extra")).withColumn("text_hash", F.xxhash64("text"))
    occurrences = durable(source.filter("doc_id is not null").select("doc_id", "text", "text_hash").mapInArrow(lambda b: _segments(b, window), "doc_id long, text_hash long, at int, n int, key long, content long"))
    variants = durable(
        occurrences.groupBy("key", "content").agg(F.min(F.struct("doc_id", "text_hash", "at", "n")).alias("rep"), F.max("doc_id").alias("last"))
        .select("key", "content", "rep", F.col("rep.doc_id").alias("m"), "last")
    )
    several = variants.groupBy("key").agg(F.count("*").alias("c"), F.min("m").alias("m0"), F.max("last").alias("m1")).filter("c > 1 and m0 < m1").select("key")
    wanted = durable(
        variants.join(several, "key", "left_semi").groupBy(F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"))
        .agg(F.collect_list(F.struct(F.col("rep.at").alias("at"), F.col("rep.n").alias("n"), "key", "content")).alias("wanted"))
    )
    kind = source.schema["extra"].dataType.simpleString()
    packed = source.mapInArrow(_pack, f"doc_id long, text_hash long, extra {kind}, packed binary")
    # Dealt by document even where the other side is broadcast, so that no stage runs two Python steps at once.
    packed = packed.repartition("doc_id", "text_hash")
    windows = durable(packed.drop("extra").join(wanted, ["doc_id", "text_hash"]).mapInArrow(lambda b: _windows(b, window), "key long, content long, i int, w long, m long"))
    smallest = windows.groupBy("key", "w").agg(F.min("m").alias("g"), F.max("m").alias("h")).filter("g < h").select("key", "w", "g")
    hits = windows.join(smallest, ["key", "w"]).filter("g < m").groupBy("key", "content").agg(F.collect_set("i").alias("hits"))
    # A variant matters where a later document has it too, or where earlier ones share some of its windows.
    active = durable(variants.join(hits, ["key", "content"], "left").filter("m < last or hits is not null").select("key", "content", "m", "hits"))
    cuts = (
        occurrences.join(active, ["key", "content"]).filter("doc_id > m or hits is not null")
        .select("doc_id", "text_hash", F.struct("at", "n", F.when(F.col("doc_id") > F.col("m"), F.lit(None)).otherwise(F.col("hits")).alias("hits")).alias("cut"))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("cut").alias("cuts"))
    )
    return packed.join(cuts, ["doc_id", "text_hash"], "left").mapInArrow(
        lambda b: _apply(b, window, rejoin), f"doc_id long, text_hash long, n_words long, n_removed long, extra {kind}, kept_text string, removed array<struct<start:long,end:long>>"
    )
