"""Near-duplicate classes from odd sketches of MinHash samples.

Plan: rows with the same shingle set collapse to one *node* (hash aggregate). For each node,
``SAMPLES`` MinHash values give ``BANDS`` band keys and are folded into a parity bitmap (the
odd sketch): sample i flips one bit, so the XOR of two bitmaps counts the samples that
differ. Bitmaps rule out most candidate pairs, full shingle sets confirm the rest.

A bucket (nodes with one band key) first tests its members against one of them (a star,
linear in the bucket). Centers are the least by a hash of the node alone, so a family has
nearly the same center in all bands and ``distinct`` folds its pairs. The first star reads
``FIRST_BANDS`` bands; confirmed links are contracted to components, and from then on only
*mixed* buckets, whose members are in several components, are read, and only pairs across
components tried: one more star over all bands, then what is left in cells. A cell holds up
to ``BLOCK`` members outside the bucket's largest component and up to ``BLOCK`` of all its
members, tries the pairs across components with the sets at hand, and emits at most one link
a member. So no step emits the pairs of a group, a family that has become one component is
never paired with itself, and no link between components is skipped.

Miss probability for a pair at similarity 0.75: (1 - 0.75**4)**40 = 2.5e-7 for the bands;
the bitmap's estimate has a standard deviation of 0.039 there and rejects under ``REJECT``,
6.5 of them lower.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._spark import durable
from folioflow.llm._text import WHITE, Words, as_long, chunks, mix, raw
from folioflow.llm.components import components, extended

SHINGLE = 5
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
BITS = 512
REJECT = 0.5
FIRST_BANDS = 4
BLOCK = 512
#: Bytes of unpacked sets that a task keeps.
HELD = 32 << 20


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk, ordered by document, and their offsets."""
    h = words.hashes()
    count, first = words.count, words.first
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    out = np.zeros(int(n.sum()), np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc]
    width = np.minimum(count, SHINGLE)[doc]
    for j in range(SHINGLE):
        use = j < width
        out[use] = mix(out[use] * np.uint64(0x9E3779B97F4A7C15) + h[at[use] + j] + np.uint64(j + 1))
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[keep], doc[keep]
    return out, np.searchsorted(doc, np.arange(len(n) + 1))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(99))
    return rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def minhash(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, SAMPLES) uint32 minima; an empty set gives the largest value everywhere."""
    factor, flip = _constants()
    out = np.full((len(offsets) - 1, SAMPLES), 2**32 - 1, np.uint32)
    low = (sets >> np.uint64(32)).astype(np.uint32)
    for d in range(len(out)):
        for s in range(offsets[d], offsets[d + 1], 1024):
            x = low[s : min(s + 1024, offsets[d + 1])]
            np.minimum(out[d], ((x[None, :] ^ flip[:, None]) * factor[:, None]).min(1), out=out[d])
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """(documents, BITS / 8) bytes: bit = parity of the samples that hash to it."""
    n = len(samples)
    spot = mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    flat = np.arange(n)[:, None] * BITS + spot.astype(np.int64)
    return np.packbits((np.bincount(flat.ravel(), minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS), axis=1)


def estimate(differing_bits: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two sketches."""
    z = np.minimum(differing_bits, BITS / 2 - 0.5)
    return 1 + BITS / (4 * SAMPLES) * np.log1p(-2 * z / BITS)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; the last six bits are the number of the band."""
    s = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2])
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j])
    return (key & ~np.uint64(63)) | np.arange(BANDS, dtype=np.uint64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in chunks(batches):
        sets, at = shingle_sets(Words(data, offsets, WHITE, lower=True))
        n = np.diff(at)
        sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
        for total, salt in zip(sums, (0x51ED270B, 0xC2B2AE35)):
            run = np.concatenate(([np.uint64(0)], np.cumsum(mix(sets + np.uint64(salt)), dtype=np.uint64)))
            total[:] = run[at[1:]] - run[at[:-1]]
        samples = minhash(sets, at)
        bands, bits = np.ascontiguousarray(band_keys(samples)), odd_sketch(samples)
        yield pa.record_batch({
            "doc_id": rows.column("doc_id"), "text_hash": rows.column("text_hash"), "n_shingles": pa.array(n.astype(np.int64)), "k1": as_long(sums[0]), "k2": as_long(sums[1]),
            "signature": pa.array([b.tobytes() + s.tobytes() for b, s in zip(bands, bits)], pa.binary()),
        })


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            data, _ = raw(part.column("signature"))
            keys = np.ascontiguousarray(data.reshape(part.num_rows, -1)[:, : BANDS * 8]).view(np.int64)
            yield pa.record_batch({"band": pa.array(keys.ravel()), "node": pa.array(np.repeat(part.column("node").to_numpy(), BANDS))})


def _sketches(column: pa.Array) -> np.ndarray:
    data, _ = raw(column)
    return np.ascontiguousarray(data.reshape(len(column), -1)[:, BANDS * 8 :]).view(np.uint64)


def _plausible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    sizes = 100 * np.minimum(n, m) >= 75 * np.maximum(n, m)
    return sizes & (estimate(np.bitwise_count(a ^ b).sum(-1)) >= REJECT)


def _filter_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ok = _plausible(_sketches(batch.column("signature_a")), _sketches(batch.column("signature_b")), batch.column("n_shingles_a").to_numpy(), batch.column("n_shingles_b").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(ok))


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Whole groups of equal ``key`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for s, e in zip(cut, cut[1:]):
            if held and held[0].column(key)[0].as_py() != k[s]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.concat_batches(held)


class _Sets:
    """Shingle sets of packed texts, the last used ones kept up to ``HELD`` bytes."""

    def __init__(self) -> None:
        self.unpack, self.known, self.size = zstandard.ZstdDecompressor(), {}, 0

    def __call__(self, name: int, packed: pa.BinaryScalar) -> np.ndarray:
        found = self.known.get(name)
        if found is None:
            text = np.frombuffer(self.unpack.decompress(packed.as_py()), np.uint8)
            found = shingle_sets(Words(text, np.array([0, len(text)]), WHITE, lower=True))[0]
            if self.size > HELD:
                self.known, self.size = {}, 0
            self.known[name] = found
            self.size += found.nbytes
        return found


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components inside each cell, tried on the full sets.

    ``side`` has bit 1 for members that are tried against all members with bit 2. A pair is
    tried in the first band that it shares. Components that a link joins count as one for the
    rest of the cell, so at most one link a member comes out.
    """
    of = _Sets()
    for group in _groups(batches, "cell"):
        node, comp, n, side = (group.column(c).to_numpy(zero_copy_only=False).copy() for c in ("node", "component", "n_shingles", "side"))
        packed = group.column("packed")
        data, _ = raw(group.column("signature"))
        data = data.reshape(len(node), -1)
        keys, bits = np.ascontiguousarray(data[:, : BANDS * 8]).view(np.int64), np.ascontiguousarray(data[:, BANDS * 8 :]).view(np.uint64)
        band = group.column("band")[0].as_py() & 63
        outside, cols = group.column("outside").to_numpy(zero_copy_only=False), np.flatnonzero(side & 2)
        for r in np.flatnonzero(side & 1).tolist():
            c = cols[comp[cols] != comp[r]]
            # Two members outside the largest component meet twice.
            c = c[~outside[c] | (node[c] > node[r])]
            c = c[(100 * np.minimum(n[c], n[r]) >= 75 * np.maximum(n[c], n[r]))]
            c = c[~(keys[c, :band] == keys[r, :band]).any(1)]
            z = np.bitwise_count(bits[c] ^ bits[r]).sum(1)
            keep = estimate(z) >= REJECT
            for k in c[keep][np.argsort(z[keep], kind="stable")].tolist():
                if comp[k] != comp[r] and _linked(of(node[r], packed[r]), of(node[k], packed[k])):
                    comp[comp == comp[k]] = comp[r]
                    yield pa.record_batch({"a": pa.array([min(node[r], node[k])]), "b": pa.array([max(node[r], node[k])])})


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for rows, data, offsets in chunks(batches):
        yield pa.record_batch({"doc_id": rows.column("doc_id"), "text_hash": rows.column("text_hash"), "packed": pa.array([pack.compress(data[s:e]) for s, e in zip(offsets, offsets[1:])], pa.binary())})


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = _Sets()
    for batch in batches:
        a, b, x, y = (batch.column(c) for c in ("a", "b", "packed_a", "packed_b"))
        keep = [_linked(of(i, x[r]), of(j, y[r])) for r, (i, j) in enumerate(zip(a.to_pylist(), b.to_pylist()))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) for every row of ``docs``.

    Two rows are linked when the similarity of their sets of distinct five-word shingles is
    at least 0.75; with one to four words the whole sequence is the only shingle. Null, empty
    and wordless texts have an empty set and are linked with nothing; their component is
    their own id. ``component_id`` is the smallest doc_id reachable; ``kept`` says that a
    row's id is that one. Rows with a null id keep a null component unless they share a set
    with another row, and kept is then false. An id may have several texts: each row is
    classed by its own, and ``text_hash`` (xxhash64 of the text) tells them apart. Repeated
    rows repeat in the result with the same values. Extra columns are ignored; an empty table
    gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = durable(source.mapInArrow(_sets, "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, signature binary"))
    # Written at once, so that each set keeps the number it is given here.
    reps = durable(
        sets.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"), F.first("signature").alias("signature"))
        .select(F.monotonically_increasing_id().alias("node"), F.col("m.doc_id").alias("doc_id"), F.col("m.text_hash").alias("text_hash"), "n_shingles", "signature", "k1", "k2")
    )
    rows = reps.select("node", "signature").mapInArrow(_bands, "band long, node long")
    shared = rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = durable(rows.join(shared, "band"))
    sketch = reps.select("node", "n_shingles", "signature")
    needed = reps.select("node", "doc_id", "text_hash").join(members.select("node").distinct(), "node")
    texts = durable(source.mapInArrow(_pack_texts, "doc_id long, text_hash long, packed binary").join(needed, ["doc_id", "text_hash"]).dropDuplicates(["node"]).select("node", "packed"))

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links: sketches first, then full sets of the rest."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for table, columns, check in ((sketch, ("n_shingles", "signature"), _filter_pairs), (texts, ("packed",), _confirm)):
            for end in ("a", "b"):
                pairs = pairs.join(table.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
            # Written between the two Python steps: in one stage each would hold a worker of its own.
            pairs = durable(pairs.mapInArrow(check, "a long, b long"))
        return pairs

    def star(rows: DataFrame, turn: int) -> DataFrame:
        """Pairs of each mixed bucket's center and the members in other components."""
        spot = F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "component")
        centers = rows.groupBy("band").agg(F.min(spot).alias("c"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1")
        centers = centers.select(F.col("band").alias("at"), F.col("c.node").alias("a"), F.col("c.component").alias("of"))
        return rows.join(centers, (F.col("band") == F.col("at")) & (F.col("component") != F.col("of"))).select("a", F.col("node").alias("b"))

    def named(found: DataFrame) -> DataFrame:
        """Members with the component that they are in."""
        return members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    alone = members.withColumn("component", F.col("node"))
    found = components(confirm(star(alone.filter(F.col("band").bitwiseAND(63) < FIRST_BANDS), 0)))
    found = extended(found, confirm(star(named(found), 1)))

    # Buckets that are still mixed try what is outside their largest component against all.
    left = named(found)
    parts = left.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    left = left.join(parts.select("band", F.col("most.component").alias("main"), F.col("most.n").alias("in_main")), "band")
    outside = F.col("component") != F.col("main")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK))).cast("int")
    left = left.select("band", "node", "component", outside.alias("outside"), blocks(F.col("size") - F.col("in_main")).alias("rows"), blocks(F.col("size")).alias("columns"))
    left = left.withColumn("i", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int")).withColumn("j", F.pmod(F.xxhash64("node"), F.col("columns")).cast("int"))
    count = lambda n: F.sequence(F.lit(0), n - 1)
    spot = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    # A member outside stands in all cells of its row and of its column, once where these cross.
    own = F.when(F.col("outside"), F.transform(count(F.col("columns")), lambda j: F.struct(F.col("i").alias("i"), j.alias("j"), F.when((j == F.col("j")), 3).otherwise(1).alias("side")))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    others = F.transform(F.filter(count(F.col("rows")), lambda i: ~F.col("outside") | (i != F.col("i"))), lambda i: spot(i, F.col("j"), 2))
    cells = left.withColumn("at", F.explode(F.concat(own, others))).select(F.xxhash64("band", "at.i", "at.j").alias("cell"), "band", "node", "component", "outside", F.col("at.side").alias("side"))
    more = cells.join(sketch, "node").join(texts, "node").repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_within, "a long, b long")
    more = durable(more.distinct())

    labels = extended(found, more)
    least = labels.join(reps.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    named_sets = labels.join(least, "component").select("node", "least")
    final = reps.select("k1", "k2", "n_shingles", "node", F.col("doc_id").alias("own")).join(named_sets, "node", "left").select("k1", "k2", "n_shingles", F.coalesce("least", "own").alias("component"))
    out = sets.select("doc_id", "text_hash", "n_shingles", "k1", "k2").join(final, ["k1", "k2", "n_shingles"], "left")
    out = out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
