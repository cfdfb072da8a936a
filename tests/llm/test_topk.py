import math

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def search(spark, rows, k=10, divisor=1):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("query_id", F.lit("clash")).withColumn("score", F.lit(1))
    v = df.withColumn("v", topk.integral(F.col("embedding"), 1024))
    return topk.top_k(v.filter(F.col("vec_id") % divisor == 0).drop("query_id").withColumnRenamed("vec_id", "query_id"), v, k)


def brute(rows, k, divisor):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % divisor == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 900)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 16).tolist(), 0) for i in range(1000)]
    assert {tuple(r) for r in search(spark, rows, 10, 50).collect()} == brute(rows, 10, 50)


def test_bounds_hold_for_large_blocks():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 200, (5000, 24)))
    q = x[:40]
    best = topk.Best(q, np.arange(40), 10)
    for s in range(0, 5000, 1700):
        best.offer(x[s : s + 1700], np.arange(s, min(s + 1700, 5000)))
    row, ids, score = best.rows()
    for r in range(40):
        all_scores = sorted(((-s, i) for i, s in enumerate((x @ q[r]).astype(int).tolist()) if i != r))[:10]
        assert [(-s, i) for s, i in all_scores] == list(zip(score[row == r].tolist(), ids[row == r].tolist()))


def test_ties_few_rows_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (5, [0.5, 0.0], 1), (3, [0.5, 0.0], 1), (9, None, 0), (10, [float("nan"), 1.0], 0), (11, [None, 1.0], 0), (12, [float("inf"), 1.0], 0), (None, [9.0, 9.0], 0), (13, [-0.25], None)]
    got = sorted(tuple(r) for r in search(spark, rows, 10, 100).collect())
    assert got == [(0, 1, 3, 512 * 1024), (0, 2, 5, 512 * 1024), (0, 3, 13, -256 * 1024)]


def test_repeated_rows_and_empty_table(spark):
    rows = [(0, [1.0], 0), (0, [1.0], 0), (1, [1.0], 0), (1, [1.0], 0)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in search(spark, rows, 10, 100).collect()) == [(0, 1, 1), (0, 2, 1)]
    assert search(spark, [], 10, 1).count() == 0


def test_vectors_of_different_lengths(spark):
    rows = [(i, [0.5] * (i % 7), 0) for i in range(40)]
    assert {tuple(r) for r in search(spark, rows, 10, 5).collect()} == brute([(i, v + [0.0] * (7 - len(v)), y) for i, v, y in rows], 10, 5)


def test_very_large_components(spark):
    rows = [(0, [1e30], 0), (1, [1e30], 0), (2, [-1e30], 0)]
    got = sorted((r.rank, r.vec_id, r.score) for r in search(spark, rows, 10, 100).collect())
    assert got == [(1, 1, 2**63 - 1), (2, 2, -(2**63))]
