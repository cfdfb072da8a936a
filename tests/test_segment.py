import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions.segment import _BEYOND, SENTENCE, folded_sentences, reassemble, segment, split_long

TEXTS = [
    "", "One sentence only.", "One. Two! Three?", "  ragged   spaces .  Here ", "a\nb", "a\n\nb", "\n\nlead", "tail\n\n", "no terminator", "line\r\nnext\r\n", "यह है। वह है।", "   ",
]


def pieces(spark, texts, limit=900):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", segment(F.col("t"), limit).alias("p")).orderBy("i").collect()
    return [r.p for r in rows]


def test_lossless(spark):
    assert ["".join(p.text for p in ps) for ps in pieces(spark, TEXTS)] == TEXTS


def test_null_and_reassemble(spark):
    df = spark.createDataFrame([(None,), ("a. B",)], "t string").select("t", reassemble(segment(F.col("t"))).alias("r"))
    assert [(r.t, r.r) for r in df.collect()] == [(None, ""), ("a. B", "a. B")]


@pytest.mark.parametrize(
    ("text", "count"),
    [
        ("One. Two! Three?", 3), ("Short title\nThen a plain line.", 2), ("Dr. Smith went home.", 1), ("See Fig. 4 for it.", 1), ("It is 3.5 percent of all.", 1), ("Go to www.example.com now.", 1),
        ("J. R. R. Tolkien wrote it.", 1), ("Das gilt bzw. Das gilt nicht.", 1), ("Es sind ca. neun.", 1), ('"Stop now." She left.', 2), ("Clause 4. Januar", 2), ("यह है। वह है।", 2), ("z.B. Das hier.", 1),
        ("", 0), (" \t", 0), ("so!no", 1), ("! x!! y", 3), ("... And", 2), ("a.\u2028", 1), ("what?! Yes", 2),
        ("मान ४.५. अगला वाक्य।", 2), ("Punkt 4. ४ Seiten", 2), ("x" + ".x" * 70 + ". Next", 1), ("." * 30 + "etc. Next one", 1), ("." * 30 + "word. Next one", 2), ("a." * 40 + " Next? Yes.", 2),
    ],
)
def test_boundaries(spark, text, count):
    (ps,) = pieces(spark, [text])
    assert sum(p.translatable for p in ps) == count


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1४.!?… ;\"')([»ä।\u00a0\x1c", max_size=40), min_size=40, max_size=40))
def test_fold_and_expression_agree(spark, texts):
    texts = [t for t in texts if t] + ["e.g. This. Dr. Who z.B. u.s.w. End. 4. Mai 4. mai (J. X) \"Q.\" No.", "See Fig. 4. Then। e.g.। X. y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folded_sentences(F.col("t")).alias("a"), F.regexp_extract_all("t", F.lit(SENTENCE), F.lit(0)).alias("b"), F.col("t").rlike(_BEYOND).alias("far"))
    for r in rows.collect():
        assert "".join(r.a) == r.t
        assert r.far or r.a == r.b, r.t


def test_closing_quote_stays(spark):
    (ps,) = pieces(spark, ['"Stop now." She left.'])
    assert [p.text for p in ps if p.translatable] == ['"Stop now."', "She left."]


@pytest.mark.parametrize(("text", "limit"), [("one clause, another clause; a third, and so on, and more, and yet more, till the end", 60), ("x" * 65, 20), ("w " * 50 + "end", 7), ("a, " + "b" * 50 + " c  d", 10)])
def test_long_split(spark, text, limit):
    (row,) = spark.createDataFrame([(text,)], "t string").select(split_long(F.col("t"), limit).alias("p")).collect()
    assert "".join(p.text for p in row.p) == text
    assert len(row.p) > 1
    assert all(len(p.text) <= limit for p in row.p)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1.!? \n,;\"')(ä।", max_size=60), min_size=30, max_size=30))
def test_lossless_for_any_text(spark, texts):
    assert ["".join(p.text for p in ps) for ps in pieces(spark, texts, 13)] == texts
