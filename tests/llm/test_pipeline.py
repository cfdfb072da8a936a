"""The pipeline against its stages in plain Python, and each stage's contract."""

import zlib
from collections import Counter

import numpy as np
import pytest
from made_up import prose
from test_neardup import brute as brute_classes
from test_packing import check_layout
from test_substring import brute as brute_cuts

import corpus_pipeline
from folioflow.llm.packing import Encoder, solve
from folioflow.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(1)
    items = [prose(900 + i, 25) for i in range(5)]
    passage = prose(800, 70)
    rows, labels = [], []
    for i in range(300):
        words = prose(i, int(rng.integers(20, 150)))
        kind = i % 10
        if kind == 0:
            for j in (2, 8, 15):
                words[j] = ["grumph", "snarlen"][j % 2]
        if kind == 1:
            words = prose(i - 9, 90) if i > 20 else words
        if kind == 2 and i > 10:
            words = rows[i - 10][1].split()
            words[len(words) // 2] = "edited"
        if kind == 3:
            words[10:10] = passage
        if kind == 4:
            words += items[i % 5]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(kind == 0)))
    rows += [(400, None), (401, ""), (402, "short"), (None, "without an id at all")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_stages(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    state = [(r.doc_id, r.text) for r in docs.collect()]

    def step(name):
        nonlocal docs
        out = steps[name](spark, docs, folder)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), DOC)
        return [(r.doc_id, r.text) for r in docs.collect()]

    after = step("toxicity")
    gone = {i for i, _ in state} - {i for i, _ in after}
    assert gone == {i for i, t in state if t and ("grumph" in t or "snarlen" in t)}

    state, after = after, step("near_dedup")
    kept = {i for i, _, _, first in brute_classes([(i, t) for i, t in state if i is not None]) if first}
    assert {i for i, _ in after} == kept | {None}

    state, after = after, step("substring_dedup")
    want = {i: (t, n) for i, _, n, t in brute_cuts([(i, t) for i, t in state if i is not None], 50)}
    texts = dict(state)
    assert dict(after) == {i: (want[i][0] if i is not None and want[i][1] else texts[i] or "") for i in texts}
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    state, after = after, step("decontamination")
    leaked = {i for i, t in state if any(f" {' '.join(x)} " in f" {t} " for x in items)}
    assert leaked
    assert {i for i, _ in after} == {i for i, _ in state} - leaked

    packed = steps["packing"](spark, docs, folder).collect()
    assert check_pieces(after, packed)


def check_pieces(state, packed):
    encode = Encoder(tokenizer_path())
    want = Counter()
    for i, t in state:
        data = encode(t or "") + b"\0\0\0\0"
        assert len(data) <= 4 * 2048
        want[i, 0, 0, len(data) // 4, zlib.crc32(data)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    return check_layout(packed, 2048) == sum(t for _, t in solve(dict(Counter(r.length for r in packed))))


def test_run_is_all_stages(spark, corpus):
    folder, _, _ = corpus
    packed = corpus_pipeline.run(spark, folder).collect()
    assert len(packed) > 100
    check_layout(packed, 2048)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, corpus, tmp_path):
    folder, _, _ = corpus
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Repeated ids with one text and with two, nulls, ties, a very long text, clashing names."""
    a, b, c = (" ".join(prose(3000 + i, 60)) for i in range(3))
    long = " ".join(prose(3100, 30_000))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (4, None), (5, ""), (None, a), (None, None), (6, long), (7, a)]
    docs = spark.createDataFrame([(i, t, None, "s", None, 1, "x", 7, "y") for i, t in rows], DOC + ", text_hash long, component_id string, length int, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None), (None, b), (1, "too few words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        stage = spark.createDataFrame(step(spark, stage, str(tmp_path)).collect(), stage.schema)
        assert stage.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode = Encoder(tokenizer_path())
    # Copies of a under larger ids go, b stays though its id has a copy too; a row without an id loses and takes no part.
    left = [(1, a), (2, b), (3, c), (3, c), (4, ""), (5, ""), (None, a), (None, ""), (6, long)]
    assert sorted(((r.doc_id, r.text) for r in stage.collect()), key=str) == sorted(left, key=str)
    want = Counter((i, len(encode(t)) // 4 + 1) for i, t in left)
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.length
    assert total == Counter({i: sum(n * k for (j, n), k in want.items() if j == i) for i, _ in left})
    check_layout(packed, 2048)
