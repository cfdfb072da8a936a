import re
import sys
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.operators import failures, fit, geometry, layout, tooling
from folioflow.sinks import documents
from folioflow.sources import adapters

COMMANDS = "doc_id long, page_index int, block_id int, line_no long, text string, x double, baseline double, size double, ink struct<r:double,g:double,b:double>, bold boolean"


def drawn(data):
    """Pages of a PDF as lists of (font, size, x, y, text), found through its cross references."""
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    count = int(re.match(rb"xref\n0 (\d+)", data[start:])[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data[start:])]
    assert len(places) == count - 1
    objects = {n: data[p : data.index(b"\nendobj", p)] for n, p in enumerate(places, 1)}
    assert all(o.startswith(b"%d 0 obj" % n) for n, o in objects.items())
    pages = []
    for kid in re.findall(rb"(\d+) 0 R", re.search(rb"/Kids \[(.*?)\]", objects[2])[1]):
        content = objects[int(re.search(rb"/Contents (\d+) 0 R", objects[int(kid)])[1])]
        text = zlib.decompress(content.split(b"stream\n", 1)[1].rsplit(b"\nendstream", 1)[0])
        found = re.findall(rb"/F(\d) ([\d.]+) Tf 1 0 0 1 ([\d.-]+) ([\d.-]+) Tm \((.*)\) Tj", text)
        pages.append([(int(f), float(s), float(x), float(y), re.sub(rb"\\(.)", rb"\1", t).decode("cp1252")) for f, s, x, y, t in found])
    return pages


def test_pdf_files_hold_what_is_drawn(spark):
    ink = (0.0, 0.5, 1.0)
    rows = [(1, 1, 0, 0, "second (page)", 72.0, 100.0, 10.0, ink, False), (1, 0, 1, 1, "back\\slash é €", 72.5, 130.0, 9.5, ink, True), (1, 0, 1, 0, "first", 72.0, 118.0, 9.5, ink, True), (1, 0, 0, 0, "हिन्दी", 72.0, 50.0, 22.0, ink, False), (2, 0, 0, 0, "other", 1.0, 2.0, 3.0, ink, False)]
    files = documents.pdf_files(documents.page_commands(spark.createDataFrame(rows, COMMANDS)), 595.0, 842.0)
    got = {r.doc_id: (r.page_count, bytes(r.pdf)) for r in files.collect()}
    assert got[1][0] == 2
    assert drawn(got[1][1]) == [[(1, 22.0, 72.0, 792.0, "??????"), (2, 9.5, 72.0, 724.0, "first"), (2, 9.5, 72.5, 712.0, "back\\slash é €")], [(1, 10.0, 72.0, 742.0, "second (page)")]]
    assert drawn(got[2][1]) == [[(1, 3.0, 1.0, 840.0, "other")]]


def test_saving_is_all_or_nothing(spark, tmp_path):
    rows = spark.range(10)
    folder = f"{tmp_path}/a/b/out"
    assert documents.save(rows, folder) is None
    assert documents.save(rows.filter("id < 3"), folder) is None
    assert spark.read.parquet(folder).count() == 3
    broken = rows.select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("v"))
    assert documents.save(broken, f"{tmp_path}/bad") == "CANNOT_WRITE"
    assert not (tmp_path / "bad").exists()
    documents.publish(spark, folder, f"{tmp_path}/final/out")
    assert spark.read.parquet(f"{tmp_path}/final/out").count() == 3


class Proportional:
    """Half as wide for i and l as for other letters."""

    ascender, descender = 0.7, 0.3

    def width(self, text, size):
        return (F.length(text) - F.length(F.regexp_replace(text, "[^il]", "")) * 0.5) * size


def test_any_measurer_can_wrap_and_fit(spark):
    def lines(text, width, measure):
        return spark.range(1).select(fit.wrap(F.lit(text), F.lit(1.0), F.lit(width), measure).alias("x")).first().x

    assert lines("oak ill elm lilililil", 6.0, Proportional()) == ["oak ill", "elm", "lilililil"]
    assert lines("iiiiabc", 2.0, Proportional()) == ["iiii", "ab", "c"]
    assert lines("oak elm", 3.0, fit.Ruler(advance=1.0)) == ["oak", "elm"]
    schema = "doc_id long, page_index int, block_id int, translation string, font_size double, line_height double, available_width double, available_height double"
    rows = spark.createDataFrame([(1, 0, 0, "ill " * 12, 10.0, 12.0, 100.0, 40.0), (1, 0, 1, "oak " * 12, 10.0, 12.0, 100.0, 40.0)], schema)
    a, b = fit.fit(rows, Proportional()).orderBy("block_id").collect()
    assert a.fit_size > b.fit_size
    same = fit.fit(rows).orderBy("block_id").select("fit_size", "fit_lines").collect()

    class AsRuler:
        ascender, descender = 0.8, 0.2
        width = staticmethod(lambda text, size: F.length(text) * size * 0.5)

    assert fit.fit(rows, AsRuler()).orderBy("block_id").select("fit_size", "fit_lines").collect() == same


def test_failures_have_messages(spark):
    rows = spark.createDataFrame([(1, "NO_ROUTE"), (2, None), (3, "ODD")], "id int, error_code string")
    got = {r.id: (r.message, r.display) for r in failures.described(rows).collect()}
    assert got[2] == (None, None)
    assert got[3] == ("ODD", "ODD")
    assert got[1][1].startswith(got[1][0] + "\n")
    assert len({f.code for f in failures.FAILURES}) == len(failures.FAILURES)


def test_direction_and_upright_pages(spark):
    glyph = "doc_id long, page_index int, pos long, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, color int, flags int, direction array<double>"
    rows = [(1, 0, 0, "a", 0.0, 0.0, 6.0, 10.0, 10.0, "", 0, 0, [1.0, 0.0]), (1, 0, 1, "b", 6.0, 0.0, 12.0, 10.0, 10.0, "", 0, 0, [0.0, 1.0]), (1, 0, 2, "c", 12.0, 0.0, 18.0, 10.0, 10.0, "", 0, 0, None)]
    assert [r.text for r in layout.lines(spark.createDataFrame(rows, glyph)).collect()] == ["a c"]
    pages = spark.createDataFrame([(595.0, 842.0, 90), (595.0, 842.0, -180), (595.0, 842.0, None)], "width double, height double, rotation int")
    up = geometry.upright(pages)
    assert [tuple(r.frame) for r in up.collect()] == [(0, 0, 842, 595), (0, 0, 595, 842), (0, 0, 595, 842)]
    assert [(r.width, r.height, r.rotation) for r in geometry.restored(up).collect()] == [(595, 842, 90), (595, 842, 180), (595, 842, 0)]


def test_first_present_and_banner_without_missing(spark):
    wanted = spark.createDataFrame([(2, "/b"), (1, "/a"), (3, "/c")], "rank int, path string")
    assert [r.path for r in tooling.first_present(wanted, spark.createDataFrame([("/c",), ("/b",)], "path string")).collect()] == ["/b"]
    none = spark.createDataFrame([], "directory string")
    assert tooling.start_banners(none, F.lit(True)).count() == 0


class Stub:
    """A module or object with the given attributes."""

    def __init__(self, **held):
        self.__dict__.update(held)


def batch(**columns):
    return pa.record_batch({k: pa.array(v) for k, v in columns.items()})


def test_pdf_adapter_on_a_stand_in(monkeypatch):
    char = lambda c, x: {"c": c, "bbox": (x, 0, x + 5, 9)}
    line = lambda chars, way: {"dir": way, "spans": [{"chars": chars, "size": 9, "font": "Serif-Bold", "color": 3, "flags": 16}]}
    turned = []
    page = Stub(number=0, set_rotation=turned.append, get_text=lambda kind: {"blocks": [{"lines": [line([char("a", 0), char("b", 5)], (1, 0)), line([char("x", 0)], (0, 1))]}, {}]})

    class Document(list):
        needs_pass = False

    def opened(stream, filetype):
        if stream == b"broken":
            raise ValueError(stream)
        found = Document([page])
        found.needs_pass = stream == b"locked"
        return found

    monkeypatch.setitem(sys.modules, "pymupdf", Stub(open=opened))
    rows = [r for got in adapters._glyphs(iter([batch(path=["1", "2", "3"], content=[b"good", b"broken", b"locked"])])) for r in got.to_pylist()]
    assert turned == [0]
    assert [(r["path"], r["text"], r["pos"], r["x0"], r["error_code"]) for r in rows] == [("1", "a", 0, 0.0, None), ("1", "b", 1, 5.0, None), ("2", None, None, None, "CANNOT_OPEN"), ("3", None, None, None, "ENCRYPTED")]


def test_recogniser_adapter_on_a_stand_in(tmp_path):
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\nread x; test \"$x\" = bad && exit 1; echo \"$x $3 $4\"\n")
    tool.chmod(0o755)
    one = batch(doc_id=[1, 2], page_index=pa.array([0, 0], pa.int32()), png=[b"good\n", b"bad\n"])
    (got,) = adapters._recognised(iter([one]), str(tool), "eng", 20)
    assert [(r["tsv"], r["error_code"]) for r in got.to_pylist()] == [("good -l eng\n", None), (None, "OCR_UNAVAILABLE")]
    (got,) = adapters._recognised(iter([one]), str(tmp_path / "none"), "eng", 20)
    assert got.column("error_code").to_pylist() == ["OCR_UNAVAILABLE"] * 2


def test_model_adapter_on_a_stand_in(monkeypatch):
    calls = []

    def translate_batch(tokens, **options):
        calls.append((len(tokens), options["max_decoding_length"]))
        if any("fail" in t for t in tokens):
            raise RuntimeError("inference")
        return [Stub(hypotheses=[[w.upper() for w in t]]) for t in tokens]

    class Pieces:
        def __init__(self, model_file):
            assert "lost" not in model_file

        encode = staticmethod(lambda texts, out_type: [t.split() for t in texts])
        decode = staticmethod(" ".join)

    monkeypatch.setitem(sys.modules, "sentencepiece", Stub(SentencePieceProcessor=Pieces))
    monkeypatch.setitem(sys.modules, "ctranslate2", Stub(Translator=lambda folder, compute_type: Stub(translate_batch=translate_batch)))
    one = batch(pair=["p"] * 4, sentence=["a b", "c", "w " * 60 + "w", "x x x x x fail"])
    (got,) = adapters._translated(iter([one]), "folder", 2)
    assert got.column("translation").to_pylist() == ["A B", "C", "W " * 60 + "W", None]
    assert calls == [(2, 16), (1, 26), (1, 191)]
    (got,) = adapters._translated(iter([one]), "lost", 2)
    assert got.column("translation").null_count == 4
