import collections
import math
import re

import numpy as np
import pytest
from made_up import prose
from pyspark.sql import functions as F

from folioflow.llm import lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), None]


def brute_base(rows, learn):
    count = collections.Counter(t for i, x in rows if learn(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    return {i: (len(w), sum(count[t] > 0 for t in w), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in w)) for i, x in rows for w in [tokens(x)]}


class Tree:
    """Context-tree weighting of one binary node, straight from its definition."""

    def __init__(self, data, depth=0):
        # data: (context bytes from the nearest, bit)
        self.n = [sum(b == k for _, b in data) for k in (0, 1)]
        self.kids = {}
        if depth < lm.DEPTH:
            groups = collections.defaultdict(list)
            for c, b in data:
                groups[c[depth]].append((c, b))
            self.kids = {k: Tree(g, depth + 1) for k, g in groups.items()}
        a, b = self.n
        self.kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        rest = sum(t.weighted for t in self.kids.values())
        self.weighted = np.logaddexp(self.kt, rest) - math.log(2) if self.kids else self.kt
        self.odds = math.exp(min(700, self.kt - rest)) if self.kids else None

    def one(self, c, depth=0):
        own = (self.n[1] + 0.5) / (sum(self.n) + 1)
        if not self.kids:
            return own
        below = self.kids[c[depth]].one(c, depth + 1) if c[depth] in self.kids else 0.5
        return (self.odds * own + below) / (self.odds + 1)


def brute_score(train, text):
    samples = collections.defaultdict(list)
    for t in train:
        x = [lm.STOP] * lm.DEPTH + list(t.encode()) + [lm.STOP]
        for i in range(lm.DEPTH, len(x)):
            for k in range(8):
                samples[(1 << k) | (x[i] >> (8 - k))].append((tuple(x[i - d] for d in range(1, lm.DEPTH + 1)), x[i] >> (7 - k) & 1))
    trees = {k: Tree(v) for k, v in samples.items()}
    x = [lm.STOP] * lm.DEPTH + list(text.encode()) + [lm.STOP]
    total = 0.0
    for i in range(lm.DEPTH, len(x)):
        c = tuple(x[i - d] for d in range(1, lm.DEPTH + 1))
        for k in range(8):
            node = (1 << k) | (x[i] >> (8 - k))
            p = trees[node].one(c) if node in trees else 0.5
            total += math.log10(p if x[i] >> (7 - k) & 1 else 1 - p)
    return total


def test_base_score(spark, documents, monkeypatch):
    rows = [(i, " ".join(prose(i, 30)) + " Word\tWORD") for i in range(40)] + [(50, None), (51, ""), (52, "Unseen unseen2")]
    learn = lambda i: i % 4 != 0 and i < 52
    held = (F.col("doc_id") % 4 == 0) | (F.col("doc_id") >= 52)
    want = brute_base(rows, learn)
    for head in (10, 262_144):
        monkeypatch.setattr(lm, "HEAD", head)
        got = lm.score(documents(rows), held).collect()
        assert len(got) == len(rows)
        for r in got:
            n, known, total, base = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert r.base_score == pytest.approx(base)


def test_score_follows_the_definition(spark, documents):
    train = ["abracadabra", "abra abra", "bad cab", "dab a cab", "a\0b \0"]
    rows = [(i, t) for i, t in enumerate(train)] + [(10, "cabra"), (11, "zebra é"), (12, ""), (13, "a\0\0")]
    got = {r.doc_id: r.score for r in lm.score(documents(rows), F.col("doc_id") >= 10).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(brute_score(train, t), rel=1e-4), t


def test_every_context_has_its_node(spark, documents, monkeypatch):
    """More contexts than any fixed table of old; also when most pairs are found by the join, in several steps."""
    rng = np.random.default_rng(3)
    rows = [(i, "".join(chr(97 + min(25, int(k))) for k in rng.exponential(5, 700))) for i in range(40)]
    train = [t for i, t in rows if i < 38]
    assert len({(d, t[max(0, k - d) : k]) for t in train for k in range(len(t)) for d in range(1, 6)}) > 40_000
    for pairs, step in ((1 << 20, 1 << 18), (100, 1000)):
        monkeypatch.setattr(lm, "PAIRS", pairs)
        monkeypatch.setattr(lm, "STEP", step)
        got = {r.doc_id: r.score for r in lm.score(documents(rows), F.col("doc_id") >= 38).collect()}
        for i in (0, 38, 39):
            assert got[i] == pytest.approx(brute_score(train, rows[i][1]), rel=1e-7)


def test_kept_contexts_partition_the_data(monkeypatch):
    """With few nodes, the others of a node share one child and probabilities still sum to one."""
    rng = np.random.default_rng(1)
    x = rng.integers(97, 101, 3000)
    count = collections.Counter()
    for i in range(4, len(x)):
        for d in range(5):
            count[d, sum(int(x[i - k]) << (8 * (k - 1)) for k in range(1, d + 1)), int(x[i])] += 1
    size = collections.Counter()
    for (d, c, _), n in count.items():
        size[d, c] += n
    keep = {k for k, n in size.items() if k[0] == 0 or n > 150}
    rows = np.array([(*k, n) for k, n in count.items() if k[:2] in keep])
    child, table = lm.build(*rows.T)
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-5)
    node = np.zeros(1, int)
    for _ in range(lm.DEPTH):
        node = child[node, 97]
    assert (child[node[0]] == node[0]).all()


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.9, 30.0, 1e6])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_familiar_text_costs_less(spark, documents):
    rows = [(i, " ".join(prose(i, 80))) for i in range(60)] + [(100, " ".join(prose(1000, 80))), (101, " ".join("".join(reversed(w)) for w in prose(1000, 80)))]
    got = {r.doc_id: r.bits_per_byte for r in lm.score(documents(rows), F.col("doc_id") >= 100).collect()}
    assert got[100] < 0.8 * got[101]


def test_edges(spark, documents):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "a"), (3, "a"), (4, "b " * 50_000)]
    docs = documents(rows).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1)).withColumn("rid", F.lit(1))
    got = lm.score(docs, F.col("doc_id") == 3).collect()
    assert len(got) == 6
    assert all(r.score < 0 and r.held_out == (r.doc_id == 3) for r in got)
    assert lm.score(documents([]), F.col("doc_id") == 3).count() == 0
    nothing = lm.score(documents([(3, "ab")]), F.lit(True)).collect()
    assert nothing[0].train_tokens == 0
    assert nothing[0].base_score == 0
    assert nothing[0].score == pytest.approx(3 * 8 * math.log10(0.5))
