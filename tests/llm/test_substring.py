import hashlib
import re

import numpy as np
from made_up import prose
from pyspark.sql import functions as F

from folioflow.llm import substring as s
from folioflow.llm._text import mix


def brute(rows, window):
    words = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def run(docs, **more):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in s.remove_repeats(docs, **more).collect())


def messy(seed):
    """Documents that share passages, with edits, runs of one word and periods."""
    rng = np.random.default_rng(seed)
    alphabet = [["a"], ["a", "b"], ["a", "b", "c"], prose(seed, 40)][seed % 4]
    pool = [list(rng.choice(alphabet, rng.integers(20, 120))) for _ in range(4)] + [["run"] * 130, ["p", "q", "r"] * 40]
    rows = []
    for i in range(25):
        words = []
        for _ in range(rng.integers(1, 4)):
            part = list(pool[rng.integers(len(pool))])
            part = part[rng.integers(0, len(part) // 2) :]
            if rng.random() < 0.4:
                part[rng.integers(len(part))] = f"edit{rng.integers(5)}"
            words += part + list(rng.choice(alphabet, rng.integers(0, 4)))
        rows.append((int(rng.integers(0, 1000)) * 30 + i, " ".join(words)))
    return rows


def test_against_brute_force(spark, documents):
    for seed in range(4):
        rows = messy(seed)
        assert run(documents(rows)) == brute(rows, 50)


def test_other_windows(spark, documents):
    rows = messy(3)
    assert run(documents(rows), window=12) == brute(rows, 12)


def test_equal_windows_pick_equal_keys():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 3, 400)
    docs = [np.concatenate((rng.integers(0, 3, 9), base[k : k + 150], rng.integers(0, 3, 9))) for k in range(0, 240, 30)]
    h = mix(np.concatenate(docs).astype(np.uint64) + np.uint64(3))
    first = np.concatenate(([0], np.cumsum([len(x) for x in docs])))
    doc, at, n, key, _ = s.segments(h, first)
    found = {}
    for d, a, c, k in zip(doc, at, n, key):
        for j in range(c):
            g = first[d] + a + j
            found.setdefault(tuple(h[g : g + 50].tolist()), set()).add(int(k))
    assert all(len(v) == 1 for v in found.values())


def test_recompression_parses_equal_interiors_equally():
    rng = np.random.default_rng(8)
    shared = mix(rng.integers(0, 9, 200).astype(np.uint64))
    a, b = mix(rng.integers(0, 9, 40).astype(np.uint64)), mix(rng.integers(0, 9, 57).astype(np.uint64))
    h = np.concatenate((a, shared, b, shared, a))
    first = np.array([0, 240, 240 + 57 + 200 + 40])
    name, start, end, left, right = s.recompress(h, first)
    inside = lambda low: {(n, int(x - low)) for n, x, y, z in zip(name.tolist(), start, left, right) if y >= low and z <= low + 200}
    assert inside(40) == inside(240 + 57)
    assert len(inside(40)) > 40


def test_edges(spark, documents):
    passage = " ".join(prose(1, 60))
    rows = [(5, passage), (5, passage), (7, passage), (7, passage), (1, None), (2, ""), (3, " \n "), (9, passage + "\n" + "tail " * 60), (11, "long " * 40_000)]
    docs = documents(rows).withColumn("kept_text", F.lit("x")).withColumn("text_hash", F.lit(1))
    assert run(docs) == brute(rows, 50)
    assert run(documents([])) == []
    loose = documents([(None, passage), (3, passage), (4, passage)])
    got = {r.doc_id: r.n_removed for r in s.remove_repeats(loose).collect()}
    assert got == {None: 0, 3: 0, 4: 60}


def test_one_id_with_two_texts(spark, documents):
    a, b = " ".join(prose(1, 70)), " ".join(prose(2, 70))
    rows = [(1, a), (1, b), (2, a), (3, b)]
    assert run(documents(rows)) == brute(rows, 50)


def test_carried_columns_and_untouched_texts(spark, documents):
    passage = " ".join(prose(1, 60))
    got = s.remove_repeats(documents([(1, "  two\n words "), (2, passage), (3, passage)]), carry=("lang",), rejoin=False).collect()
    assert {r.doc_id: (r.kept_text, r.extra.lang) for r in got} == {1: ("  two\n words ", "en"), 2: (passage, "en"), 3: ("", "en")}
    (r,) = [r for r in got if r.doc_id == 3]
    assert [(x.start, x.end) for x in r.removed] == [(0, 60)]
    assert hashlib.sha256(r.kept_text.encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
