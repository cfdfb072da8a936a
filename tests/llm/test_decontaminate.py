import itertools

import numpy as np
from made_up import prose
from pyspark.sql import functions as F

from folioflow.llm import decontaminate as d

ITEM = "item_id long, text string"


def bench(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def test_masks_reach_every_overlap_with_two_substitutions():
    for bad in itertools.chain(*(itertools.combinations(range(d.OVERLAP), k) for k in (0, 1, 2))):
        assert any(all(s + o not in bad for o in mask) for mask in d.MASKS for s in range(d.OVERLAP - mask[-1]))


def test_copies_with_substitutions(spark, documents):
    item = prose(1, 30)
    changed = list(item)
    for k in (4, 11, 19, 26):
        changed[k] = "other"
    rows = [
        (1, " ".join(prose(10, 50) + item + prose(11, 50))), (2, " ".join(prose(12, 50) + changed + prose(13, 5))), (3, " ".join(prose(14, 80) + item[:12])), (4, " ".join(prose(15, 80) + item[8:22])), (5, " ".join(prose(16, 400))),
        (6, " ".join(w.upper() + "," for w in item)),
    ]
    got = {(r.doc_id, r.item_id): r for r in d.contaminated(documents(rows), bench(spark, [(7, " ".join(item))])).collect()}
    assert set(got) == {(1, 7), (2, 7), (4, 7), (6, 7)}
    assert (got[1, 7].start, got[1, 7].length, got[1, 7].matched) == (50, 30, 30)
    assert got[2, 7].matched >= 0.8 * got[2, 7].length


def test_short_items_count_whole(spark, documents):
    rows = [(1, "x " + " ".join(prose(2, 6)) + " y"), (2, " ".join(prose(2, 6)[:5])), (3, "a b c")]
    items = [(1, " ".join(prose(2, 6))), (2, "a b c"), (3, ""), (4, None), (None, " ".join(prose(2, 6)))]
    assert [(r.doc_id, r.item_id) for r in d.contaminated(documents(rows), bench(spark, items)).collect()] == [(1, 1)]


def test_short_items_with_every_placement_of_substitutions(spark, documents):
    """As many words as the rule allows are replaced, anywhere; one more, and it is no leak."""
    items = {n: prose(800 + n, n) for n in range(5, 13)}
    rows, want = [], set()
    for n, item in items.items():
        for most in (n // 5, n // 5 + 1):
            for bad in itertools.combinations(range(n), most):
                text = [f"q{k}" if k in bad else w for k, w in enumerate(item)]
                if most == n // 5:
                    want.add((len(rows), n))
                rows.append((len(rows), " ".join([f"a{n}", *text, f"b{n}"])))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(documents(rows), bench(spark, [(n, " ".join(item)) for n, item in items.items()])).collect()}
    assert got == want


def test_blocks_of_items_give_the_same(spark, documents, monkeypatch):
    items = [(i, " ".join(prose(100 + i, 20))) for i in range(30)]
    docs = documents([(i, " ".join(prose(200 + i, 30)) + " " + items[i][1]) for i in range(30)])
    one = {tuple(r) for r in d.contaminated(docs, bench(spark, items)).collect()}
    monkeypatch.setattr(d, "BLOCK_WORDS", 300)
    assert {tuple(r) for r in d.contaminated(docs, bench(spark, items)).collect()} == one
    assert {(a, b) for a, b, *_ in one} >= {(i, i) for i in range(30)}


def test_against_brute_force(spark, documents):
    rng = np.random.default_rng(5)
    items = [prose(300 + i, int(rng.integers(13, 40))) for i in range(12)]
    rows = []
    for i in range(40):
        words = prose(400 + i, 120)
        item = list(items[rng.integers(12)])
        part = item[rng.integers(0, max(1, len(item) - 13)) :]
        for k in range(len(part)):
            if rng.random() < 0.2:
                part[k] = "zzz"
        words[60:60] = part
        rows.append((i, words))
    want = set()
    for i, words in rows:
        for j, item in enumerate(items):
            for o in range(-len(item) + 1, len(words)):
                same = [words[o + k] == item[k] for k in range(len(item)) if 0 <= o + k < len(words)]
                if sum(same) >= 11 and qualifies(same, 13):
                    want.add((i, j))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(documents([(i, " ".join(w)) for i, w in rows]), bench(spark, [(j, " ".join(t)) for j, t in enumerate(items)])).collect()}
    assert got == want
    assert 10 < len(want) < 40


def qualifies(same, need):
    """The stated rule, straight from its words."""
    return any(5 * sum(same[s:e]) >= 4 * (e - s) for s in range(len(same)) for e in range(s + need, len(same) + 1))


def test_masks_reach_every_stretch_of_the_rule():
    """All placements for 13 to 25 words; a longer stretch has such a part."""
    masks = [(sum(1 << o for o in m), m[-1] + 1) for m in d.MASKS]
    for n, most in ((13, 2), (15, 3), (20, 4), (25, 5)):
        for bad in itertools.combinations(range(n), most):
            left = (1 << n) - 1 - sum(1 << k for k in bad)
            assert any(left >> s & m == m for m, width in masks for s in range(n - width + 1)), (n, bad)


def test_overlap_is_the_best_of_all_stretches():
    rng = np.random.default_rng(7)
    for _ in range(1500):
        same = rng.random(int(rng.integers(1, 45))) < rng.choice((0.6, 0.75, 0.8, 0.9))
        got = d.overlap(same, 100)
        assert (got is not None) == qualifies(same.tolist(), 13), same
        if got:
            start, length, matched = got
            assert length >= 13 and matched == same[start : start + length].sum() and 5 * matched >= 4 * length


def test_phrases_replaced(spark, documents):
    """Equal (digits) and replaced (in brackets) runs of words; 80 % or more agree but for the last."""
    cases = [("10", "[3]", "10"), ("8", "[4]", "8"), ("8", "[3]", "8", "[3]", "8"), ("4", "[1]", "4", "[1]", "4", "[1]", "4", "[1]", "4"), ("2", "[1]", "9", "[2]", "1"), ("8", "[5]", "8")]
    items, rows = [], []
    for i, case in enumerate(cases):
        item, text = prose(500 + i, 60), []
        for run in case:
            n = int(run.strip("[]"))
            text += [f"zz{i}"] * n if run[0] == "[" else item[len(text) : len(text) + n]
        items.append((i, " ".join(item[: len(text)])))
        rows.append((i, " ".join(prose(600 + i, 40) + text + prose(700 + i, 40))))
    found = {(r.doc_id, r.item_id) for r in d.contaminated(documents(rows), bench(spark, items)).collect()}
    assert found >= {(i, i) for i in range(5)}
    assert (5, 5) not in found
    assert {r.doc_id for r in d.clean(documents(rows), bench(spark, items)).collect()} == {i for i, _ in rows} - {i for i, _ in found}


def test_edges(spark, documents):
    item = " ".join(prose(1, 20))
    odd = documents([(1, None), (2, ""), (None, item), (3, item), (3, item), (4, (item + " ") * 3000)]).withColumn("item_id", F.lit("x")).withColumn("start", F.lit(0))
    got = sorted(((r.doc_id or -1), r.item_id) for r in d.contaminated(odd, bench(spark, [(9, item), (9, item)])).collect())
    assert got == [(-1, 9), (3, 9), (3, 9), (4, 9)]
    assert d.contaminated(odd, bench(spark, [])).count() == 0
    assert d.contaminated(documents([]), bench(spark, [(9, item)])).count() == 0
    kept = d.clean(odd, bench(spark, [(9, item)]))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
