import pytest
from pyspark.sql import functions as F

from folioflow.operators import catalog, tooling
from folioflow.plans import report
from folioflow.sources import first_set, listing, spread


def test_listing_finds_complete_models(spark, tmp_path):
    for model, files in {"opus-mt-en-de": catalog.MODEL_FILES, "opus-mt-de-en": catalog.MODEL_FILES[:2]}.items():
        (tmp_path / model).mkdir()
        for f in files:
            (tmp_path / model / f).write_bytes(b"x")
    found = listing(spark, str(tmp_path))
    assert [r.directory for r in catalog.installed(found).collect()] == ["opus-mt-en-de"]
    left = {r.directory for r in catalog.missing(catalog.models(spark), found).collect()}
    assert left == {"opus-mt-de-en", "opus-mt-en-hi", "opus-mt-hi-en"}


def test_spread_only_small_inputs(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores + 3)
    assert spread(many) is many


def test_first_set():
    assert first_set(None, "", "a", "b") == "a"
    assert first_set(None) is None


def test_version_and_fonts(spark):
    row = spark.range(1).select(tooling.version_parts(F.lit("1.x")).alias("v"), tooling.is_truetype(F.lit(b"\x00\x01\x00\x00zz")).alias("t"), tooling.is_truetype(F.lit(b"<html>")).alias("h")).first()
    assert (row.v, row.t, row.h) == (["1", "0", "0", "0"], True, False)
    wanted = spark.createDataFrame([("a.ttf",), ("b.ttf",)], "name string")
    present = spark.createDataFrame([("a.ttf", 5000), ("b.ttf", 10)], "name string, length long")
    assert [r.name for r in tooling.fonts_to_fetch(wanted, present).collect()] == ["b.ttf"]


@pytest.mark.parametrize(
    ("counts", "text"),
    [
        ((1, 1, 0, 0, 0), "1 page · 1 block translated"),
        ((3, 7, 2, 1, 4), "3 pages · 7 blocks translated · 2 page(s) read with OCR · 1 page(s) had no text and were left as they were · 4 block(s) were too long to fit and run on"),
    ],
)
def test_summary(spark, counts, text):
    assert spark.range(1).select(report.summary(*map(F.lit, counts)).alias("s")).first().s == text


def test_codes_and_progress(spark):
    rows = spark.createDataFrame([(0, 0, False), (2, 0, False), (2, 0, True), (2, 5, False)], "p int, b int, o boolean").select(report.error_code(F.col("p"), F.col("b"), F.col("o")).alias("e")).collect()
    assert [r.e for r in rows] == ["NO_PAGES", "NO_TEXT", "NO_TEXT_AFTER_OCR", None]
    assert [tooling.hop_progress(*x) for x in ((0, 2, 0.5), (1, 2, 1.0), (0, 0, 0.0))] == [0.25, 1.0, 1.0]
    assert tooling.run_cancellable(spark, "folioflow-test", lambda: spark.range(3).count()) == 3
