"""Language-model scores by context-tree weighting over byte contexts.

Every byte is eight binary decisions; each decision has its own tree over the last
``DEPTH`` bytes. A node's Krichevsky-Trofimov estimate is weighted against the product of
its children's weighted probabilities, so all depths mix, each with the weight the corpus
gives it. The corpus is counted whole, by a groupBy over (context, byte) pairs, and every
context that occurs has a node of its own: the tree grows with the corpus.

What a position costs depends only on its context and its byte, so it is worked out once
for each distinct pair, also for pairs that only scored rows have (their count is 0). The
pairs are dealt by their last three bytes; depths 5 to 3 are weighted there, bottom up. The
sums per two last bytes and binary decision, whose number has a bound that no corpus
exceeds, are weighted on the driver. On the way down a node's mixture is an affine function
of the one below it, so each pair's cost is found from its own group and those functions.

Look-ups have two steps, for pairs (``PAIRS``) as for words (``HEAD``): the most frequent are
found in a broadcast table, all others by a join. Both give the same values.

The add-one unigram base score needs the count of every word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._spark import durable
from folioflow.llm._text import WHITE, Words, as_long, chunks

DEPTH = 5
#: The end symbol: a byte that no UTF-8 text has.
STOP = 0xFF
PAIRS = 1 << 20
HEAD = 262_144
END = np.uint64(0xE2D0F7E87A5B0C11)
HOLD = 1 << 19
#: Rows that are weighted at a time, up to the end of a group.
STEP = 1 << 18
#: Where the depth of a context stands above its bytes.
LEVEL = 8 * DEPTH + 8


def _add_up(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sums per key, held for a whole partition up to HOLD keys at a time."""

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[at], np.add.reduceat(counts, at)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for keys, counts in pairs:
        if len(keys):
            held.append((keys, counts))
            size += len(keys)
        if size > 2 * HOLD:
            held = [merge(held)]
            size = len(held[0][0])
            if size > HOLD:
                yield pa.record_batch({"k": as_long(held[0][0]), "c": pa.array(held[0][1])})
                held, size = [], 0
    if held:
        keys, counts = merge(held)
        for s in range(0, len(keys), 100_000):
            yield pa.record_batch({"k": as_long(keys[s : s + 100_000]), "c": pa.array(counts[s : s + 100_000])})


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(keys, return_counts=True)
    return keys, counts.astype(np.int64)


def _with_end(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk with one END after each document, and offsets of the documents."""
    h = words.hashes()
    first = words.first + np.arange(len(words.first))
    out = np.full(len(h) + len(words.count), END, np.uint64)
    out[np.arange(len(h)) + words.doc] = h
    return out, first


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _add_up(_unique(_with_end(Words(d, o, WHITE, lower=True))[0]) for _, d, o in chunks(batches))


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with DEPTH end symbols before and after each document, positions to score, and their offsets.

    The first of those after a document is scored as its end.
    """
    n, docs = len(data), len(offsets) - 1
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    x = np.full(n + DEPTH * (docs + 1), STOP, np.uint8)
    x[np.arange(n) + DEPTH * (doc + 1)] = data
    ends = offsets[1:] + DEPTH * np.arange(1, docs + 1)
    scored = np.zeros(len(x), bool)
    scored[np.arange(n) + DEPTH * (doc + 1)] = True
    scored[ends] = True
    return x, np.flatnonzero(scored), offsets + np.arange(docs + 1)


def _pairs(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Context and byte of each position; the nearest byte is the highest, the byte itself the lowest."""
    key = x[at].astype(np.uint64)
    for d in range(1, DEPTH + 1):
        key |= x[at - d].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - d))
    return key


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of all rows; those of rows that are not learned from count 0."""

    def keys() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows, data, offsets in chunks(batches):
            x, at, docs = layout(data, offsets)
            key = _pairs(x, at)
            learn = np.repeat(rows.column("learn").to_numpy(zero_copy_only=False).astype(bool), np.diff(docs))
            yield _unique(key[learn])
            others = np.unique(key[~learn])
            yield others, np.zeros(len(others), np.int64)

    return _add_up(keys())


def frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of ``table`` with the largest counts: all above a limit that leaves at most ``most``."""
    level = F.floor(F.log2(F.col(count).cast("double")) * 8).cast("int")
    sizes = sorted(((r["level"], r["n"]) for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    low, total = None, 0
    for at, n in sizes:
        total += n
        if total > most:
            break
        low = at
    return table.filter(F.lit(False)) if low is None else table.filter(level >= low)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0 (Stirling's series beyond 8)."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


_HALF = log_gamma(np.arange(1 << 16) + 0.5)
_WHOLE = log_gamma(np.arange(1 << 16) + 1.0)


def estimated(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""

    def look(table: np.ndarray, n: np.ndarray, more: float) -> np.ndarray:
        out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
        big = n >= len(table)
        if big.any():
            out[big] = log_gamma(n[big] + more)
        return out

    return look(_HALF, zero, 0.5) + look(_HALF, one, 0.5) - look(_WHOLE, zero + one, 1.0) - math.log(math.pi)


def weighed(zero: np.ndarray, one: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted probability (ln) of nodes with children, and the odds of their own estimate."""
    own = estimated(zero, one)
    return np.logaddexp(own, below) - math.log(2), np.exp(np.clip(own - below, -700, 700))


def passed(line: tuple[np.ndarray, np.ndarray], zero: np.ndarray, one: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mixture at the root as a + b * (that of the child), one depth further down."""
    a, b = line
    b = b / (odds + 1)
    return a + b * odds * (one + 0.5) / (zero + one + 1), b


class Decision:
    """Depths 3 to 5 of the trees of one binary decision, for whole groups of three last bytes.

    ``zero``, ``one``: counts of the nodes of each depth; ``up``: their parents' numbers.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, j: int):
        symbol = key & 255
        code = key >> 24 << 32 | (1 << j | symbol >> (8 - j)) << 24 | key & 0xFFFFFF
        self.order = np.argsort(code)
        code = code[self.order]
        self.bit = (symbol[self.order] >> (7 - j) & 1).astype(bool)
        n = count[self.order].astype(np.float64)
        self.zero, self.one, self.up, last = {}, {}, {}, None
        for d in (3, 4, 5):
            node = code >> (8 * (6 - d))
            new = np.concatenate(([True], node[1:] != node[:-1]))
            at = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            self.one[d] = np.add.reduceat(np.where(self.bit, n, 0), at)
            self.zero[d] = np.add.reduceat(n, at) - self.one[d]
            if d == 3:
                # Two last bytes and the binary node.
                self.top = code[at] >> 40 << 8 | code[at] >> 24 & 255
            else:
                self.up[d] = last[at]
            last = of
        self.leaf = last
        below = np.bincount(self.up[5], estimated(self.zero[5], self.one[5]))
        below, self.odds4 = weighed(self.zero[4], self.one[4], below)
        self.weighted, self.odds3 = weighed(self.zero[3], self.one[3], np.bincount(self.up[4], below))

    def chance(self, line: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Probability of each row's bit, in the order of ``order``."""
        a, b = passed(line, self.zero[3], self.one[3], self.odds3)
        a, b = passed((a[self.up[4]], b[self.up[4]]), self.zero[4], self.one[4], self.odds4)
        p = a[self.up[5]] + b[self.up[5]] * (self.one[5] + 0.5) / (self.zero[5] + self.one[5] + 1)
        return np.where(self.bit, p[self.leaf], 1 - p[self.leaf])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted pairs and their counts, about STEP at a time, never parting a group of three last bytes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("k").to_numpy(), batch.column("c").to_numpy()))
            size += batch.num_rows
        if size >= STEP:
            key, count = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1] >> 24 << 24))
            if cut:
                yield key[:cut], count[:cut]
            held, size = [(key[cut:], count[cut:])], len(key) - cut
            # A group larger than a step is not put together again for each batch.
            size = 0 if not cut else size
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, count in _groups(batches):
        for j in range(8):
            x = Decision(key, count, j)
            at, of = np.unique(x.top, return_inverse=True)
            yield pa.record_batch({"at": at, "zero": np.bincount(of, x.zero[3]).astype(np.int64), "one": np.bincount(of, x.one[3]).astype(np.int64), "below": np.bincount(of, x.weighted)})


def top_lines(at: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, a, b) of two last bytes and binary node: see ``passed``."""
    order = np.argsort(at)
    at, zero, one, below = at[order], zero[order].astype(np.float64), one[order].astype(np.float64), below[order]
    nodes = [(at, zero, one, *weighed(zero, one, below))]
    ups = []
    for _ in range(2):
        low, zero, one, weighted, _ = nodes[-1]
        code, up = np.unique(low >> 16 << 8 | low & 255, return_inverse=True)
        zero, one, below = (np.bincount(up, x, len(code)) for x in (zero, one, weighted))
        nodes.append((code, zero, one, *weighed(zero, one, below)))
        ups.append(up)
    a, b = np.zeros(len(nodes[2][0])), np.ones(len(nodes[2][0]))
    for i in (2, 1, 0):
        _, zero, one, _, odds = nodes[i]
        a, b = passed((a, b), zero, one, odds)
        if i:
            a, b = a[ups[i - 1]], b[ups[i - 1]]
    return at, a, b


def _fall(batches: Iterator[pa.RecordBatch], top: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    code, a, b = top
    for key, count in _groups(batches):
        cost = np.zeros(len(key))
        for j in range(8):
            x = Decision(key, count, j)
            at = np.searchsorted(code, x.top)
            cost[x.order] += np.log10(x.chance((a[at], b[at])))
        for s in range(0, len(key), 100_000):
            yield pa.record_batch({"k": key[s : s + 100_000], "c": count[s : s + 100_000], "cost": cost[s : s + 100_000]})


class Slots:
    """Values of frequent keys by hash; of two keys for one slot the more frequent has it, the other tries a second table."""

    def __init__(self, key: np.ndarray, value: np.ndarray, count: np.ndarray):
        order = np.argsort(count, kind="stable")
        key, value = key[order], value[order]
        self.tables = []
        for bits in (21, 20):
            keys, values = np.full(1 << bits, np.iinfo(np.uint64).max), np.zeros(1 << bits)
            at = self.slot(key, bits)
            keys[at], values[at] = key, value
            self.tables.append((bits, keys, values))
            lost = keys[at] != key
            key, value = key[lost], value[lost]

    @staticmethod
    def slot(key: np.ndarray, bits: int) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15 if bits & 1 else 0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key, 0 where it is not known, and whether it is."""
        (bits, keys, values), (bits2, keys2, values2) = self.tables
        at = self.slot(key, bits)
        known = keys[at] == key
        value = np.where(known, values[at], 0)
        rest = np.flatnonzero(~known)
        at = self.slot(key[rest], bits2)
        ok = keys2[at] == key[rest]
        value[rest[ok]] = values2[at[ok]]
        known[rest[ok]] = True
        return value, known


def _listed(keys: np.ndarray, who: np.ndarray, docs: int) -> pa.Array:
    """For each document the list of its distinct keys, with how often each occurs."""
    order = np.lexsort((keys, who))
    keys, who = keys[order], who[order]
    new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])))) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.append(new, len(keys)))
    lists = np.searchsorted(who[new], np.arange(docs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([as_long(keys[new]), pa.array(times)], ["k", "n"]))


def build(depth: np.ndarray, context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Path table and log10 probabilities, both of shape (rows, 256), from counts of kept contexts.

    The tree of a small corpus on one machine. ``score`` does not use it: it has no such limit.

    Inputs list (depth, context, symbol, count); a context's last byte is its low one. Row 0
    of the path table is the root, entry [node, byte] the node one byte further back.
    """
    code = depth.astype(np.int64) << LEVEL | context
    nodes = np.unique(np.append(code, 0))
    ids = np.searchsorted(nodes, code)
    level = nodes >> LEVEL
    bits = nodes & ((1 << LEVEL) - 1)
    keep = len(nodes)
    inner = np.zeros(keep, bool)
    parent = np.zeros(keep, np.int64)
    for d in range(1, DEPTH + 1):
        at = np.flatnonzero(level == d)
        parent[at] = np.searchsorted(nodes, (d - 1) << LEVEL | (bits[at] & ((1 << (8 * (d - 1))) - 1)))
    inner[parent[level > 0]] = True
    others = np.flatnonzero(inner)
    rows = keep + len(others)
    counts = np.zeros((rows, 256))
    np.add.at(counts, (ids, symbol), count)
    parent = np.concatenate((parent, others))
    level = np.concatenate((level, level[others] + 1))
    real = np.flatnonzero(level[:keep] > 0)
    spare = np.full(rows, -1)
    spare[others] = keep + np.arange(len(others))
    counts[keep:] = counts[others]
    np.subtract.at(counts, spare[parent[real]], counts[real])

    child = np.repeat(np.arange(rows, dtype=np.int32)[:, None], 256, 1)
    child[others] = spare[others][:, None]
    child[parent[real], bits[real] >> (8 * (level[real] - 1))] = real

    # Binary nodes 1..255 of a byte: node k has children 2k (bit 0) and 2k + 1 (bit 1).
    tree = np.zeros((rows, 512))
    tree[:, 256:] = counts
    del counts
    for k in range(255, 0, -1):
        tree[:, k] = tree[:, 2 * k] + tree[:, 2 * k + 1]
    zero, one = tree[:, 2:512:2], tree[:, 3:512:2]
    estimate = (one + 0.5) / (zero + one + 1)
    alone = np.empty((rows, 255))
    for s in range(0, rows, 1024):
        z, o = zero[s : s + 1024], one[s : s + 1024]
        alone[s : s + 1024] = log_gamma(z + 0.5) + log_gamma(o + 0.5) - log_gamma(z + o + 1) - math.log(math.pi)
    del tree, zero, one
    # Weighted probabilities, deepest first; a node with children weighs itself against them.
    below = np.zeros((rows, 255))
    odds = np.zeros((rows, 255))
    split = np.zeros(rows, bool)
    split[others] = True
    for d in range(DEPTH + 1, -1, -1):
        at = np.flatnonzero(level == d)
        weighted = alone[at]
        s = np.flatnonzero(split[at])
        own, rest = alone[at[s]], below[at[s]]
        weighted[s] = np.logaddexp(own, rest) - math.log(2)
        odds[at[s]] = np.exp(np.clip(own - rest, -700, 700))
        if d:
            np.add.at(below, parent[at], weighted)
    del below, alone
    table = np.zeros((rows, 256), np.float32)
    for s in range(0, rows, 1024):
        at = np.arange(s, min(s + 1024, rows))
        p, up = estimate[at], at.copy()
        for _ in range(DEPTH + 1):
            move = up > 0
            up = np.where(move, parent[up], up)
            mixed = (odds[up] * estimate[up] + p) / (odds[up] + 1)
            p = np.where(move[:, None], mixed, p)
        logs = np.zeros((len(at), 1))
        for depth_bits in range(8):
            k = slice((1 << depth_bits) - 1, (2 << depth_bits) - 1)
            logs = np.stack((logs + np.log10(1 - p[:, k]), logs + np.log10(p[:, k])), 2).reshape(len(at), -1)
        table[at] = logs
    return child, table


def _score(batches: Iterator[pa.RecordBatch], model: tuple) -> Iterator[pa.RecordBatch]:
    pairs, words, logs = model
    for rows, data, offsets in chunks(batches):
        x, at, docs = layout(data, offsets)
        n = len(docs) - 1
        key = _pairs(x, at)
        cost, easy = pairs.find(key)
        score = np.add.reduceat(cost, docs[:-1])
        others = _listed(key[~easy], np.repeat(np.arange(n), np.diff(docs))[~easy], n)

        h, first = _with_end(Words(data, offsets, WHITE, lower=True))
        doc = np.repeat(np.arange(n), np.diff(first))
        spot = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
        head = words[spot] == h if len(words) else np.zeros(len(h), bool)
        gain = np.bincount(doc[head], logs[spot[head]], n) if len(words) else np.zeros(n)
        known = np.bincount(doc[head], minlength=n)
        yield pa.record_batch({
            "rid": rows.column("rid"), "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(np.diff(first)),
            "known": pa.array(known.astype(np.int64)), "gain": pa.array(gain), "score": pa.array(score), "pairs": others, "tail": _listed(h[~head], doc[~head], n),
        })


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row.

    ``held_out`` is a boolean column over ``docs``; rows where it is false are learned from,
    with all their words and bytes. Null texts are empty: one end token, one end symbol. Where
    ``held_out`` is null the row is not learned from and counts as not held out. Repeated rows
    count and are scored each. Without training rows the model is uniform over bytes and the
    base score is 0. ``score`` includes the end symbol. Extra columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    train = source.filter(~F.col("held_out")).select("text")
    words = durable(train.mapInArrow(_count_words, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")))
    learn = F.coalesce(~F.col("held_out"), F.lit(False)).alias("learn")
    grams = durable(source.select(learn, "text").mapInArrow(_count_bytes, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")))

    grouped = grams.repartition(F.shiftright("k", 24)).sortWithinPartitions("k")
    sums = grouped.mapInArrow(_rise, "at long, zero long, one long, below double").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("zero", "one", "below"))).toArrow()
    top = docs.sparkSession.sparkContext.broadcast(top_lines(*(sums.column(c).to_numpy() for c in ("at", "zero", "one", "below"))))
    costs = durable(grouped.mapInArrow(lambda b: _fall(b, top.value), "k long, c long, cost double"))
    often = frequent(costs.filter("c > 0"), "c", PAIRS).toArrow()
    pairs = Slots(often.column("k").to_numpy().view(np.uint64), often.column("cost").to_numpy(), often.column("c").to_numpy())

    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = int(total["n"]), int(total["v"])
    head = frequent(words, "c", HEAD).toArrow()
    keys = head.column("k").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = docs.sparkSession.sparkContext.broadcast((pairs, keys[order], np.log10(head.column("c").to_numpy()[order] + 1.0)))

    scored = durable(
        source.withColumn("held_out", F.coalesce("held_out", F.lit(False))).withColumn("rid", F.monotonically_increasing_id())
        .mapInArrow(lambda b: _score(b, model.value), "rid long, doc_id long, held_out boolean, n_bytes long, n_tokens long, known long, gain double, score double, pairs array<struct<k:long,n:long>>, tail array<struct<k:long,n:long>>")
    )
    tail = scored.select("rid", F.explode("tail").alias("t")).select("rid", "t.k", "t.n").join(words, "k")
    tail = tail.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("also"))
    rare = scored.select("rid", F.explode("pairs").alias("t")).select("rid", "t.k", "t.n").join(costs.select("k", "cost"), "k")
    rare = rare.groupBy("rid").agg(F.sum(F.col("n") * F.col("cost")).alias("rare"))
    base = F.col("gain") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(tokens + distinct + 1))
    whole = scored.drop("tail", "pairs").join(tail, "rid", "left").join(rare, "rid", "left").withColumn("score", F.col("score") + F.coalesce("rare", F.lit(0.0)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
