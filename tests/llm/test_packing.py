import zlib
from collections import Counter

import numpy as np
import pytest
from made_up import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=25))
def test_plans_hold_every_piece(counts):
    plan = packing.solve(counts, 100)
    held = Counter()
    for content, times in plan:
        assert sum(content) <= 100
        assert times > 0
        for n in content:
            held[n] += times
    assert held == Counter(counts)
    size = sum(t for _, t in plan)
    assert packing.lower_bound(counts, 100) <= size if counts else size == 0
    assert size <= sum(t for _, t in packing.best_fit(counts, 100))


def optimum(items, capacity):
    best = len(items)

    def walk(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                rest = list(rooms)
                rest.remove(room)
                walk(i + 1, [*rest, room - items[i]])
        walk(i + 1, [*rooms, capacity - items[i]])

    walk(0, [])
    return best


@pytest.mark.parametrize("seed", range(8))
def test_small_cases_are_optimal(seed):
    rng = np.random.default_rng(seed)
    items = sorted(rng.integers(10, 70, 9).tolist(), reverse=True)
    assert sum(t for _, t in packing.solve(dict(Counter(items)), 100)) == optimum(items, 100)


def test_completion_beats_best_fit():
    counts = {60: 2, 50: 2, 45: 2, 40: 1, 35: 2, 30: 2, 20: 2, 15: 2, 10: 1}
    assert sum(t for _, t in packing.solve(counts, 100)) <= sum(t for _, t in packing.best_fit(counts, 100))
    assert sum(t for _, t in packing.solve({6: 20, 4: 10, 3: 40}, 10)) == 30


@pytest.mark.parametrize("seed", [24, 68, 111, 119, 128])
def test_wider_searches_have_their_own_nodes(seed):
    """With few nodes, the narrow search uses up what the wider ones would need."""
    counts = dict(Counter(np.random.default_rng(seed).integers(15, 70, 60).tolist()))
    assert sum(t for _, t in packing.solve(counts, 100, 60)) == packing.lower_bound(counts, 100)


def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def plain_ids(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_the_plain_tokenizer():
    encode, plain = packing.Encoder(PATH), plain_tokenizer()
    texts = [" ".join(prose(i, 50)) for i in range(20)] + ["a  b", "x\n\n y", "don't 's", " \t  x", "“quoted” — dash", "<|endoftext|> hi", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "ñ é 12ab ½ 漢字 ́x", "", "  ", "\r\n x\x0b y", "a\x85b", "tab\t\tx \n", "ÀÉÎ ßü", "1234567890", "it's we'll I'd"]
    for t in texts * 2:
        assert encode(t) == plain_ids(plain, t), t
    assert 50256 in np.frombuffer(encode("x<|endoftext|>"), "<u4")


ENCODER = []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdefghij ETAOIN'’.,;:-_<|>0123456789\n\t\r\u00a0éüßñ"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoder_equals_the_plain_tokenizer_on_any_text(text):
    if not ENCODER:
        ENCODER.extend((packing.Encoder(PATH), plain_tokenizer()))
    assert ENCODER[0](text) == plain_ids(ENCODER[1], text)


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents_are_cut_and_packed(spark, documents):
    rows = [(i, " ".join(prose(i, int(n)))) for i, n in enumerate(np.random.default_rng(1).integers(0, 400, 60))] + [(100, None), (101, ""), (102, "word " * 5000), (7, "again"), (7, "again"), (None, "no id")]
    docs = documents(rows).withColumn("sequence_id", F.lit("x")).withColumn("length", F.lit(1)).withColumn("ids", F.lit(1))
    cut = packing.pieces(docs, PATH)
    got = packing.pack(cut).collect()
    encode = packing.Encoder(PATH)
    want = Counter()
    for i, t in rows:
        data = encode(t or "") + b"\0\0\0\0"
        n = len(data) // 4
        first = n % 2048 or 2048 if n > 2048 else n
        cuts = [0, *range(first, n + 1, 2048)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, s, e - s, zlib.crc32(data[4 * s : 4 * e])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got) == want
    size = check_layout(got, 2048)
    assert size == sum(t for _, t in packing.solve(dict(Counter(r.length for r in got))))
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(cut)).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(r.length for r in got)


def test_hot_lengths_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11 + 1).cast("long").alias("length"))
    got = packing.pack(rows, 20).collect()
    assert len({r.id for r in got}) == len(got) == 1000
    assert check_layout(got, 20) <= -(-sum(r.length for r in got) // 20) + 1


def test_empty_table(spark, documents):
    assert packing.pack(packing.pieces(documents([]), PATH)).count() == 0
    assert packing.solve({}) == []
