import re

import numpy as np
from made_up import prose
from pyspark.sql import functions as F

from folioflow.llm import neardup
from folioflow.llm.components import components, extended

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return sorted((i, len(x), root(i), root(i) == i) for i, x in sets)


def run(docs):
    return sorted(tuple(r) for r in neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())


def family(seed, n, size, edits):
    rng = np.random.default_rng(seed)
    base, out = prose(seed, size), []
    for _ in range(n):
        words = list(base)
        for k in rng.integers(0, size, rng.integers(0, edits + 1)):
            words[k] = f"e{rng.integers(1000)}"
        out.append(" ".join(words))
    return out


def test_against_brute_force(spark, documents):
    texts = [t for s in range(12) for t in family(s, 8, 60 + 20 * s, 4)] + ["a b", "A  b", "a", "a b c d", "x y z w v", "X Y z w\nv"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    assert run(documents(rows)) == brute(rows)


def test_one_wide_family(spark, documents, monkeypatch):
    """Similarities from 0.5 to 1: most links do not go through any one document, and cells are small."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = list(enumerate(family(5, 150, 120, 6)))
    assert run(documents(rows)) == brute(rows)


def test_ids_with_several_texts(spark, documents, monkeypatch):
    """Each row is classed by its own text, whatever else stands under its id."""
    for block in (16, 512):
        monkeypatch.setattr(neardup, "BLOCK", block)
        members = list(enumerate(family(6, 150, 120, 6)))
        others = [(i, " ".join(prose(7000 + i, 30))) for i, _ in members]
        got = neardup.near_duplicates(documents(members + others)).collect()
        by_row = {(r.doc_id, r.n_shingles == 26): (r.component_id, r.kept) for r in got}
        assert len(got) == 300
        alone = {i: c for i, _, c, _ in brute(members)}
        for i, _ in members:
            assert by_row[i, True] == (i, True)
            assert by_row[i, False] == (alone[i], alone[i] == i)


def test_tight_family_and_strangers_in_its_buckets(spark, documents, monkeypatch):
    """One large component and members under the threshold that share its buckets."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    tight = family(8, 60, 120, 1)
    loose = family(8, 40, 120, 14)
    rows = list(enumerate(tight + loose))
    assert run(documents(rows)) == brute(rows)


def test_a_chain(spark, documents):
    words = prose(3, 100)
    rows = []
    for i in range(12):
        rows.append((i * 7 % 12, " ".join(words[i * 6 : i * 6 + 100] + prose(50 + i, max(0, i * 6)))[: 100 * 9]))
    base = prose(9, 400)
    rows = [(i * 7 % 13, " ".join(base[i * 8 : i * 8 + 100])) for i in range(13)]
    assert run(documents(rows)) == brute(rows)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    for j in (0.6, 0.75, 0.9):
        n = 4000
        both = rng.integers(0, 2**63, int(n * j), dtype=np.uint64)
        rest = rng.integers(0, 2**63, n - len(both), dtype=np.uint64)
        half = len(rest) // 2
        x, y = np.concatenate((both, rest[:half])), np.concatenate((both, rest[half:]))
        samples = neardup.minhash(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]))
        bits = neardup.odd_sketch(samples).view(np.uint64)
        assert abs(neardup.estimate(np.bitwise_count(bits[0] ^ bits[1]).sum()) - j) < 0.2


def test_no_pair_at_the_threshold_is_rejected():
    """Estimates of 20,000 pairs at similarity 0.75 and 0.78: unbiased, close, and none under the limit."""
    rng = np.random.default_rng(3)
    for j in (0.75, 0.78):
        same = rng.random((20_000, neardup.SAMPLES)) < j
        a, b = (rng.integers(0, 2**32, same.shape, dtype=np.uint32) for _ in range(2))
        x, y = (neardup.odd_sketch(v).view(np.uint64) for v in (a, np.where(same, a, b)))
        got = neardup.estimate(np.bitwise_count(x ^ y).sum(1))
        assert abs(got.mean() - j) < 0.003 and got.std() < 0.045
        assert (got >= neardup.REJECT).all()


def test_edges(spark, documents):
    text = " ".join(prose(1, 40))
    rows = [(1, None), (2, ""), (3, "  "), (4, text), (4, text), (5, text.upper()), (6, "w " * 30_000), (7, "w"), (8, "w w w w w")]
    docs = documents(rows).withColumn("kept", F.lit("x")).withColumn("node", F.lit(1)).withColumn("component_id", F.lit(2))
    got = run(docs)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 36, 4, True), (4, 36, 4, True), (5, 36, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 6, False)])
    assert run(documents([])) == []
    assert run(documents([(1, "only one here")])) == [(1, 1, 1, True)]
    nulls = neardup.near_duplicates(documents([(None, text), (9, text), (None, "")])).collect()
    assert sorted(((r.doc_id or -1), (r.component_id or -1), r.kept) for r in nulls) == [(-1, -1, False), (-1, 9, False), (9, 9, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (102, 101), (50, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, 50: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_grow(spark):
    rng = np.random.default_rng(5)
    for first, more in ((30, 12), (0, 12)):
        edges = [tuple(int(x) for x in rng.integers(0, 60, 2)) for _ in range(first + more)]
        table = [spark.createDataFrame(e, "a long, b long") for e in (edges, edges[:first], edges[first:])]
        whole, grown = (sorted(map(tuple, t.select("node", "component").collect())) for t in (components(table[0]), extended(components(table[1]), table[2])))
        assert whole == grown


def test_rounds_start_from_components_found(documents, monkeypatch):
    """The links of a family are walked once, not again after each step that looks for more."""
    tables, write = [], neardup.durable
    monkeypatch.setattr("folioflow.llm.components.durable", lambda df: tables.append(df) or write(df))
    text = " ".join(f"w{i}" for i in range(80))
    got = run(documents([(i, f"{text} end{i} of{i} it{i}") for i in range(1, 9)]))
    assert {r[2] for r in got} == {1}
    assert len(tables) <= 5
