import os
import re

import numpy as np
import pytest
from made_up import prose
from pyspark.sql import functions as F

from folioflow.llm import quality, toxicity
from folioflow.llm._labels import labelled_sample
from folioflow.llm._spark import remainder

LABELS = "doc_id long, y int"


def held(n, r):
    return remainder(F.col("doc_id"), n) == r


def toxic_set(spark, documents, n=400):
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 60)
        bad = i % 5 == 0
        if bad:
            for j in (3, 20, 40):
                words[j] = ["grumph", "snarlen", "snarling"][(i + j) % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return documents(rows), spark.createDataFrame(labels, LABELS)


def test_toxicity_on_held_out_rows(spark, documents):
    docs, labels = toxic_set(spark, documents)
    got = toxicity.score(docs, labels, held(3, 1)).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 80
    assert np.mean([r.predicted == r.y for r in got]) > 0.97
    assert all(r.evidence for r in got if r.predicted)


def test_toxicity_filter_keeps_columns(spark, documents):
    docs, labels = toxic_set(spark, documents)
    kept = toxicity.clean(docs.withColumn("score", F.lit("x")), labels, held(3, 1))
    assert kept.columns == [*docs.columns, "score"]
    assert kept.join(labels, "doc_id").filter("y = 0").count() >= 315
    assert kept.join(labels, "doc_id").filter("y = 1").count() <= 3


def test_neighbours_are_exact():
    rng = np.random.default_rng(1)
    vectors = rng.random((700, 40)) * (rng.random((700, 40)) < 0.1)
    vectors = vectors[vectors.any(1)]
    vectors /= np.sqrt((vectors**2).sum(1))[:, None]
    vectors[300:310] = vectors[5]
    doc, term = np.nonzero(vectors)
    index = toxicity.make_index(doc, term, vectors[doc, term], np.arange(40, dtype=np.uint64), np.ones(40), np.zeros(len(vectors)), rng.permutation(len(vectors)), 0.1)
    for i in range(60):
        (t,) = np.nonzero(vectors[i])
        cosine, row = toxicity.nearest(t, vectors[i, t], index, 8, i)
        exact = vectors @ vectors[i]
        exact[i] = -1
        want = np.lexsort((index.ids, -np.round(exact, 9)))[:8]
        assert row.tolist() == want[exact[want] > 0].tolist()
        assert np.allclose(cosine, exact[row])


def brute_toxicity(rows, labels, learn, k=15):
    """Scores by dense vectors over all words, written from the docstrings."""
    words = {i: re.findall("[0-9A-Za-z\x80-\U0010ffff]+", t or "") for i, t in rows}
    examples, seen = [], set()
    for i, y in sorted(labels):
        name = (y, tuple(sorted(w.lower() for w in words[i]))) if i in words else None
        if learn(i) and i in words and name not in seen:
            seen.add(name)
            examples.append((i, y))
    vocabulary = sorted({w.lower() for i, _ in examples for w in words[i]})
    at = {w: j for j, w in enumerate(vocabulary)}

    def counts(i):
        v = np.zeros(len(vocabulary))
        for w in words[i]:
            if w.lower() in at:
                v[at[w.lower()]] += 1
        return v

    y = np.array([b for _, b in examples], float)
    x = np.array([counts(i) for i, _ in examples])
    n, share, df = len(y), y.mean(), (x > 0).sum(0)
    lift = ((x > 0).T @ y + 4 * share) / (df + 4) - share
    weight = (np.log((n + 1) / (df + 1)) + 1) * np.maximum(lift / (1 - share), 0.02)
    unit = lambda v: (u := np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0) * weight) / max(np.sqrt((u**2).sum()), 1e-12)
    vectors = np.array([unit(v) for v in x])
    ids = np.array([i for i, _ in examples])

    def vote(q, skip=-1):
        c = vectors @ q
        if skip >= 0:
            c[skip] = 0
        near = np.lexsort((ids, -np.round(c, 9)))[:k]
        near = near[c[near] > 0]
        w = c[near] ** 2 / (1.05 - np.minimum(c[near], 1))
        return (w * y[near]).sum() / (w.sum() + 1), ids[near[:3]].tolist()

    steps = toxicity.isotonic(np.array([vote(v, j)[0] for j, v in enumerate(vectors)]), y)
    out = {}
    for i, _ in rows:
        q = unit(counts(i))
        got, near = vote(q)
        out[i] = (np.interp(got, *steps), near) if q.any() else ((y.sum() + 0.5) / (n + 1), [])
    return out


def test_toxicity_against_brute_force(spark, documents):
    """The whole operator: all words, both labels, exact neighbours, votes and calibration."""
    docs, labels = toxic_set(spark, documents, 150)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900, "notaword"), (901, "")]
    rows += [(700 + j, rows[j][1]) for j in range(6)]
    want = brute_toxicity(rows, [(r.doc_id, r.y) for r in labels.collect()] + [(700, 1), (701, 0)], lambda i: i % 4 != 1)
    more = labels.unionByName(spark.createDataFrame([(700, 1), (701, 0)], LABELS))
    got = toxicity.score(documents(rows), more, F.col("doc_id") % 4 == 1).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id][0], abs=1e-6)
        assert r.evidence == want[r.doc_id][1]
    assert sum(len(r.evidence) == 3 for r in got) == len(rows) - 2


def test_an_id_with_many_texts_keeps_the_bound(spark, documents):
    docs, labels = toxic_set(spark, documents, 60)
    many = docs.unionByName(documents([(0, f"another text number {j}") for j in range(50)]))
    assert labelled_sample(many, labels, F.lit(True), 40).count() <= 40


def test_quality_on_held_out_rows(spark, documents):
    rows, labels = [], []
    for i in range(400):
        words = prose(i, 80)
        poor = i % 4 == 0
        text = " | ".join(words) if poor and i % 8 else " ".join(f"{w}%%%" for w in words) if poor else " ".join(words)
        rows.append((i, text))
        labels.append((i, int(not poor)))
    got = quality.score(documents(rows), (y := spark.createDataFrame(labels, LABELS)), held(5, 0)).join(y, "doc_id").filter("held_out").collect()
    assert len(got) > 50
    assert np.mean([r.predicted == r.y for r in got]) > 0.97


def test_pairwise_term_equals_the_sum_over_pairs():
    machine = quality.Machine()
    rng = np.random.default_rng(2)
    feature = np.array([3, 8, 11, 40])
    x = rng.normal(size=4)
    machine.linear[:50] = rng.normal(size=50)
    raw, _ = machine.score(np.zeros(4, int), feature, x, 1)
    pairs = sum(machine.factor[feature[i]] @ machine.factor[feature[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert raw[0] == pytest.approx(machine.bias + machine.linear[feature] @ x + pairs)


def test_quality_against_brute_force(spark, documents):
    """The query's scores, from the fitted weights by a double loop over all features of each document."""
    rows = [(i, " ".join(prose(i, 12 + i % 9)) + ["", " | |", "\nx\nx"][i % 3]) for i in range(60)] + [(90, ""), (91, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], LABELS)
    machine = quality.train(documents(rows), labels, ~held(5, 0))
    got = {r.doc_id: r.score for r in quality.score(documents(rows), labels, held(5, 0)).collect()}
    for i, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        _, feature, x = machine.rows(*quality.features(data, np.array([0, len(data)])))
        raw = machine.bias + sum(machine.linear[f] * v for f, v in zip(feature, x))
        for m in range(len(feature)):
            for k in range(m):
                raw += x[m] * x[k] * sum(p * q for p, q in zip(machine.factor[feature[m]], machine.factor[feature[k]]))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-9)


@pytest.mark.parametrize("score", [toxicity.score, quality.score])
def test_edge_rows(spark, documents, score):
    docs, labels = toxic_set(spark, documents, 120)
    odd = documents([(1000, None), (1001, ""), (1002, "  \n\t "), (1003, "word " * 30_000), (None, "no id"), (1004, "!?%|"), (1005, "é ü 漢字"), (1005, "é ü 漢字")])
    clash = docs.unionByName(odd).withColumn("score", F.lit("x")).withColumn("y", F.lit(3)).withColumn("held_out", F.lit("?"))
    strange = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 7), (1, 0), (1, 1)], LABELS))
    got = score(clash, strange, held(3, 1)).collect()
    assert len(got) == 128
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    same = [r.score for r in got if r.doc_id == 1005]
    assert len(same) == 2
    assert same[0] == same[1]


@pytest.mark.parametrize("score", [toxicity.score, quality.score])
def test_without_labels_or_documents(spark, documents, score):
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in score(documents([(1, "a b")]), none, held(3, 1)).collect()] == [0.5]
    assert score(documents([]), spark.createDataFrame([(1, 1)], LABELS), held(3, 1)).count() == 0
    assert len(score(documents([(1, ""), (2, ""), (3, "")]), spark.createDataFrame([(1, 1), (2, 1), (3, 0)], LABELS), F.lit(False)).collect()) == 3


def test_the_index_is_not_fitted_on_the_driver(spark, monkeypatch):
    driver, plain = os.getpid(), toxicity.fit

    def fit(table):
        assert os.getpid() != driver
        return plain(table)

    monkeypatch.setattr(toxicity, "fit", fit)
    docs = spark.createDataFrame([(i, f"word{i} again{i % 7}") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))
    index = toxicity.build(docs, labels, F.lit(True), 50)
    assert isinstance(index, toxicity.Index) and 0 < len(index.y) <= 50
