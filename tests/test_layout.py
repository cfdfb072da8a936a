import math
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.operators import fit, layout, ocr
from folioflow.sources import glyphs

GLYPH = "doc_id long, page_index int, pos long, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, color int, flags int"
LINE = "doc_id long, page_index int, line_id int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, color int, bold boolean, italic boolean"


def set_text(parts, size=10.0, flags=0):
    """Glyphs of (text, x, y) parts: 6 wide, 10 high."""
    rows = []
    for text, x, y in parts:
        for i, c in enumerate(text):
            rows.append((1, 0, len(rows), c, x + 6.0 * i, y, x + 6.0 * i + 6, y + 10, size, "Serif", 0, flags))
    return rows


def lines_of(spark, rows):
    return layout.lines(spark.createDataFrame(rows, GLYPH)).orderBy("line_id").collect()


def test_column_break(spark):
    assert [r.text for r in lines_of(spark, set_text([("LEFT", 10.0, 50.0), ("RIGHT", 300.0, 50.0)]))] == ["LEFT", "RIGHT"]


def test_word_gap(spark):
    # 'ONE' ends at 28; 'TWO' begins at 34.
    assert [r.text for r in lines_of(spark, set_text([("ONE", 10.0, 50.0), ("TWO", 34.0, 50.0)]))] == ["ONE TWO"]


def test_missing_size_comes_from_the_box(spark):
    rows = [(1, 0, 0, "a", 0.0, 0.0, 6.0, 20.0, None, None, None, None)]
    (line,) = lines_of(spark, rows)
    assert 17 < line.font_size < 19


def test_sloping_line_holds_together(spark):
    rows = [(1, 0, i, "a", 6.0 * i, 0.4 * i, 6.0 * i + 6, 0.4 * i + 10, 10.0, "", 0, 0) for i in range(20)]
    assert len(lines_of(spark, rows)) == 1
    steep = [(1, 0, i, "a", 6.0 * i, 3.0 * i, 6.0 * i + 6, 3.0 * i + 10, 10.0, "", 0, 0) for i in range(20)]
    assert len(lines_of(spark, steep)) > 1


def test_bad_boxes_and_blank_pages(spark):
    rows = [(1, 0, 0, "a", 0.0, 0.0, float("nan"), 10.0, 10.0, "", 0, 0), (1, 0, 1, "b", 0.0, 5.0, 6.0, 5.0, 10.0, "", 0, 0), (2, 0, 0, " ", 0.0, 0.0, 6.0, 10.0, 10.0, "", 0, 0)]
    assert lines_of(spark, rows) == []


def test_corners_in_any_order(spark):
    rows = [(1, 0, i, c, 6.0 * i + 6, 10.0, 6.0 * i, 0.0, 10.0, "", 0, 0) for i, c in enumerate("ab")]
    (line,) = lines_of(spark, rows)
    assert (line.text, line.x0, line.y0, line.x1, line.y1) == ("ab", 0.0, 0.0, 12.0, 10.0)


def brute_lines(rows):
    """Lines of a page's glyphs, one by one."""
    done, line = [], None
    unit = statistics.median(r[7] - r[5] for r in rows)
    for _, _, _, text, x0, y0, x1, y1, size, _, color, flags in rows:
        if not text.strip():
            if line:
                line["space"] = True
            continue
        if line is None or abs((y0 + y1) / 2 - sum(line["mid"]) / len(line["mid"])) > 0.5 * unit or x0 - line["right"] > 2.5 * unit:
            line = {"mid": [], "right": -math.inf, "text": "", "space": False, "sizes": [], "colors": [], "heavy": []}
            done.append(line)
        if line["text"] and not line["text"].endswith(" ") and (line["space"] or x0 - line["right"] > 0.28 * unit):
            line["text"] += " "
        line["text"] += text
        line["space"] = False
        line["mid"].append((y0 + y1) / 2)
        line["right"] = max(line["right"], x1)
        line["sizes"] += [size] if size else []
        line["colors"].append(color)
        line["heavy"].append(bool(flags & 16))
    return [(x["text"].strip(), max(statistics.median(x["sizes"]), 1.0), max(dict.fromkeys(x["colors"]), key=x["colors"].count), statistics.mean(x["heavy"]) > 0.6) for x in done]


def test_irregular_pages_against_brute_force(spark):
    rng = random.Random(4)
    pages, rows = {}, []
    for page in range(40):
        x, y, own = 0.0, 0.0, []
        for i in range(60):
            step = rng.choice([6, 6, 6, 6, 9, 40, -200])
            x, y = (x + step, y + rng.choice([0, 0, 0, 0.75, -0.5])) if step > 0 else (0.0, y + rng.choice([3, 6, 13]))
            h = rng.choice([10, 10, 8.5])
            own.append((page, 0, i, rng.choice(["a", "é", " ", "fi", "b ", "z"]), x, y, x + rng.choice([5, 6, 12]), y + h, rng.choice([10.0, 9.0]), "", rng.choice([1, 2, 3]), rng.choice([0, 16, 16])))
        pages[page] = own
        rows += own
    rng.shuffle(rows)
    got = {}
    for r in layout.lines(spark.createDataFrame(rows, GLYPH)).orderBy("doc_id", "line_id").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.font_size, r.color, r.bold))
    assert got == {p: brute_lines(own) for p, own in pages.items()}


def test_first_colour_wins_a_tie(spark):
    rows = [(1, 0, i, "a", 6.0 * i, 0.0, 6.0 * i + 6, 10.0, 10.0, "Arial-Bold", c, 0) for i, c in enumerate([7, 3, 3, 7])]
    (line,) = lines_of(spark, rows)
    assert (line.color, line.bold) == (7, True)


def line_rows(spec):
    return [(1, 0, i, s.get("text", "body"), s.get("x0", 10.0), s["y"], s.get("x1", 200.0), s["y"] + s.get("h", 10.0), s.get("size", 10.0), s.get("color", 0), s.get("bold", False), False) for i, s in enumerate(spec)]


def block_ids(spark, spec):
    return [r.block_id for r in layout.block_lines(spark.createDataFrame(line_rows(spec), LINE)).orderBy("line_id").collect()]


@pytest.mark.parametrize(
    ("spec", "ids"),
    [
        ([{"y": 0.0}, {"y": 14.0}, {"y": 28.0}], [0, 0, 0]),
        ([{"y": 0.0, "size": 22.0}, {"y": 14.0}], [0, 1]),
        ([{"y": 0.0, "size": 12.0, "bold": True}, {"y": 14.0, "size": 9.5}], [0, 1]),
        ([{"y": 0.0}, {"y": 98.0}], [0, 1]),
        ([{"y": 0.0, "x1": 100.0}, {"y": 14.0, "x0": 150.0}], [0, 1]),
        ([{"y": 200.0}, {"y": 0.0}], [0, 1]),
        ([{"y": 0.0}, {"y": 14.0, "text": "• item"}], [0, 1]),
        # Leading grows inside the block: 12, 20, then a gap that only the established leading allows.
        ([{"y": 0.0}, {"y": 18.0}, {"y": 36.0}, {"y": 60.0}], [0, 0, 0, 0]),
        ([{"y": 0.0}, {"y": 24.0}], [0, 1]),
    ],
)
def test_blocks(spark, spec, ids):
    assert block_ids(spark, spec) == ids


@pytest.mark.parametrize(
    ("a", "b", "c", "want"),
    [
        ((0.0, 100.0), (0.0, 60.0), (0.0, 90.0), "left"),
        ((0.0, 100.0), (20.0, 80.0), (30.0, 70.0), "centre"),
        ((0.0, 100.0), (40.0, 100.0), (20.0, 100.0), "right"),
    ],
)
def test_alignment(spark, a, b, c, want):
    spec = [{"y": 14.0 * i, "x0": x0, "x1": x1} for i, (x0, x1) in enumerate((a, b, c))]
    rows = layout.blocks(spark.createDataFrame(line_rows(spec), LINE).withColumn("block_id", F.lit(0))).collect()
    assert rows[0].alignment == want


def test_hyphens_sizes_and_leading(spark):
    spec = [{"y": 100.0, "text": "a well-"}, {"y": 114.0, "text": "made table and chairs"}, {"y": 128.0, "text": "was sold--", "size": 6.0}, {"y": 142.0, "text": "and"}]
    (row,) = layout.blocks(spark.createDataFrame(line_rows(spec), LINE).withColumn("block_id", F.lit(0))).collect()
    assert row.text == "a wellmade table and chairs was sold-- and"
    assert (row.font_size, row.line_height) == (10.0, 14.0)


def test_list_markers(spark):
    yes = ["• milk", "- milk", "– milk", "1. milk", "12) milk", "(3) milk", "a) milk", "iv. milk", "* milk", "४. milk", "1.\u00a0milk", "-\u2003milk"]
    no = ["milk", "1.5 litres", "milk - cold", "2031. Milk", "४५६. milk"]
    df = spark.createDataFrame([(t,) for t in yes + no], "t string").select(layout.starts_list_item(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == [True] * len(yes) + [False] * len(no)


def test_glyph_helpers(spark):
    df = spark.createDataFrame([([3.0, 4.0, 1.0, 2.0], [1.0, 0.01], 0xFF0000), ([1.0, float("inf"), 2.0, 3.0], [0.0, 1.0], 0xFFFFFF), ([1.0], None, 0x0000FF)], "b array<double>, d array<double>, c int")
    rows = df.select(layout.normal_box(F.col("b")).alias("b"), layout.horizontal(F.col("d")).alias("h"), layout.rgb(F.col("c")).alias("c")).collect()
    assert tuple(rows[0].b) == (1.0, 2.0, 3.0, 4.0)
    assert [r.b for r in rows[1:]] == [None, None]
    assert [r.h for r in rows] == [True, False, True]
    assert [tuple(r.c) for r in rows] == [(1.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.0, 0.0, 1.0)]


def test_ocr_rows(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    body = ["5\t1\t1\t1\t1\t1\t300\t600\t100\t50\t95\tHello", "5\t1\t1\t1\t1\t2\t420\t600\t100\t50\t91\tworld", "5\t1\t1\t1\t2\t1\t0\t0\t10\t10\t12\tspeck", "4\t1\t1\t1\t3\t1\t0\t0\t10\t10\t95\tlevel", "5\t1\t1\t1\tx\t1\t0\t0\t10\t10\t95\tbad", "5\t1\t1\t1\t4\t1\t0\t0\t10\t10\t\tnone"]
    parsed = ocr.parse_tsv(spark.createDataFrame([(1, "\n".join([head, *body]) + "\n")], "doc_id long, tsv string"))
    rows = parsed.select("doc_id", "pos", *(F.col("fields")[c].alias(c) for c in head.split("\t")))
    (line,) = ocr.lines(rows).collect()
    assert line.text == "Hello world"
    assert (round(line.x0, 6), round(line.y0, 6)) == (72.0, 144.0)


@pytest.mark.parametrize(("text", "factor"), [("Gray pony Bay", 1.07), ("RIVER LEVELS", 1.32), ("HARBOUR MAP", 1.32), ("summer moon", 1.32)])
def test_size_multiplier(spark, text, factor):
    assert spark.range(1).select(ocr.size_multiplier(F.lit(text)).alias("m")).first().m == factor


def test_wrap(spark):
    def lines(text, size, width):
        return spark.range(1).select(fit.wrap(F.lit(text), F.lit(size), F.lit(width)).alias("x")).first().x

    # Half a point of advance per point of size: size 2 sets one character per point.
    assert lines("oak elm fir ash yew", 2.0, 11.0) == ["oak elm fir", "ash yew"]
    assert lines("a" * 15, 2.0, 5.0) == ["a" * 5] * 3
    assert lines("x", 2.0, 0.5) == ["x"]
    assert lines("one\ntwo", 2.0, 50.0) == ["one", "two"]
    assert lines("keep all", 2.0, 0.0) == ["keep all"]


def test_fit(spark):
    schema = "doc_id long, page_index int, block_id int, translation string, font_size double, line_height double, available_width double, available_height double"
    rows = [(1, 0, 0, "short", 10.0, 12.0, 100.0, 24.0), (1, 0, 1, "x " * 30, 10.0, 12.0, 100.0, 24.0), (1, 0, 2, "x " * 4000, 10.0, 12.0, 100.0, 24.0)]
    got = fit.fit(spark.createDataFrame(rows, schema)).orderBy("block_id").collect()
    assert got[0].fit_size == 10.0
    assert got[1].fit_size < 10.0
    assert (round(got[2].fit_size, 6), got[2].overflowed) == (6.2, True)


def test_page_range(spark):
    pages = spark.createDataFrame([(1, i, 3) for i in range(3)], "doc_id long, page_index int, page_count int")
    pick = lambda a, b: sorted(r.page_index for r in ocr.selected_pages(pages, F.lit(a), F.lit(b)).collect())
    assert pick(2, 2) == [1]
    assert pick(0, 99) == [0, 1, 2]
    assert pick(7, 9) == [0, 1, 2]
    assert pick(None, None) == [0, 1, 2]


def one_by_one(x0, x1, middle, page, unit):
    """Line starts by a fold over single glyphs, its arithmetic in the order of the SQL."""
    new = []
    for k, (a, b, m, p) in enumerate(zip(x0, x1, middle, page)):
        fresh = k == 0 or p != page[k - 1] or abs(m - mean) > 0.5 * unit[p] or a - reach > 2.5 * unit[p]
        mean, n, reach = (m, 1, b) if fresh else ((mean * n + m) / (n + 1), n + 1, max(reach, b))
        new.append(fresh)
    return new


def test_rounding_of_the_running_mean():
    """Glyphs that stand just at the limit: runs of equal height are taken in one by one (pages 8185 and 11780 of sf0.1 differed)."""
    for seed in (5, 16):
        rng = random.Random(seed)
        heights = [rng.randrange(3) * 7.3 + rng.randrange(5) * 1.1 for _ in range(4000)]
        y = np.array([h for h in heights for _ in range(rng.randrange(1, 4))])
        x, page, middle = np.zeros(len(y)), np.zeros(len(y), int), (y + (y + 10.0)) / 2
        new, _ = layout._breaks(x, x, middle, page, np.array([10.0]))
        assert new.tolist() == one_by_one(x.tolist(), x.tolist(), middle.tolist(), page.tolist(), [10.0])


def test_pages_read_in_the_worker(spark):
    """Glyphs, lines and blocks of whole pages in one pass, without a shuffle, as the three operators give them; odd texts too."""
    rng = random.Random(3)
    lines = ["", " ", "\x1c ", "1. item", "word " * 30, "(iv) x", "- é中\U0001f600", "end-", "end--", "नमस्ते ", "\r", "a\tb", "- "]
    texts = [None, "", "\n", "\n" * 60, "x", "\n" * 49 + "x\ny"] + ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 140))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = layout.page_blocks(docs, glyphs.page_batches)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = layout.blocks(layout.block_lines(layout.lines_of_pages(glyphs.pages(docs))))
    assert got.schema.simpleString() == want.schema.simpleString()
    order = lambda df: df.orderBy("doc_id", "page_index", "block_id").collect()
    assert order(got) == order(want)
    small, glyphs.CHUNK = glyphs.CHUNK, 1
    try:
        names = ["doc_id", "page_index", "glyphs"]
        table = [b.to_pylist() for b in glyphs.page_batches(iter([pa.record_batch({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})]))]
    finally:
        glyphs.CHUNK = small
    plain = glyphs.pages(docs).select(*names).collect()
    assert [{**r, "glyphs": [g["text"] for g in r["glyphs"]], "pos": [g["pos"] for g in r["glyphs"]]} for b in table for r in b] == [{"doc_id": r.doc_id, "page_index": r.page_index, "glyphs": [g.text for g in r.glyphs], "pos": [g.pos for g in r.glyphs]} for r in plain]


def test_fit_by_word_ends_is_the_wrap(spark):
    """The ruler's own way against the general one, over runs of spaces, over-wide words and line breaks."""
    rng = random.Random(9)
    words = ["", "a", "bb", "ccc", "dddddddd", "e" * 40, "\U0001f600é"]
    rows = [(0, 0, k, rng.choice([" ", " ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(1, 25))), rng.choice([0.5, 7.3, 10.0, 22.0]), 12.0, rng.choice([0.0, 1.0, 3.3, 40.0, 77.7, 200.0]), rng.choice([5.0, 30.0, 90.0])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, block_id int, translation string, font_size double, line_height double, available_width double, available_height double")

    class Plain:
        ascender, descender = 0.8, 0.2
        width = staticmethod(fit.RULER.width)

    assert fit.fit(df).orderBy("block_id").collect() == fit.fit(df, Plain()).orderBy("block_id").collect()
