"""Geometry, failures, sinks, set-up and progress as queries, and folds over irregular pages, with their DuckDB equivalents.

The irregular pages take their geometry from ``lineitem``: eight orders are a page, their
items its glyphs or its lines. The SQL folds them row by row in a recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import catalog, failures, geometry, layout, tooling
from folioflow.plans import catalog_queries, document_queries, layout_queries, report, text_queries
from folioflow.sinks import documents
from folioflow.sources import spread, table

FONTS_WANTED = ("Serif.ttf", "Serif-Bold.ttf", "Script.ttf")
FONTS_PRESENT = (("Serif.ttf", 90_000), ("Script.ttf", 12))
FIRST_BYTES = (("a", "0001000000"), ("b", "4F54544F00"), ("c", "00"), ("d", ""))
ARGUMENTS = ("--quiet", "/in/notes.txt", "/in/lost.pdf", "/in/Report.PDF", "/in/second.pdf")
PRESENT = ("/in/second.pdf", "/in/Report.PDF", "/in/notes.txt")
SAVED = (("source", "hi"), ("target", "xx"), ("theme", "en"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Items in an order of their own on pages of eight orders."""
    rows = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"))
    pos = F.pmod("l_orderkey", F.lit(8)) * 1_000_000_000_000 + F.col("l_linenumber") * 100_000_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    return rows.withColumns({"doc_id": F.floor(F.col("l_orderkey") / 8).cast("long"), "page_index": F.lit(0), "pos": pos, "q": F.col("l_quantity").cast("int"), "line": F.pmod("l_orderkey", F.lit(8)).cast("int")})


def irregular_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Glyphs that wander up and down, leave gaps and stand in boxes of either orientation."""
    i, q = _items(spark, sf), F.col("q")
    # Rows of an order lie 7.3 apart, glyphs of a row up to 4.4 off: lines split and join by their running mean.
    y0 = F.col("line") * 7.3 + F.pmod(q, F.lit(5)) * 1.1
    x0 = F.col("l_linenumber") * 9.0 + F.when(q > 40, 30.0).otherwise(0.0) + F.pmod(q, F.lit(3)) * 1.5
    high = F.when(F.pmod(q, F.lit(4)) == 0, 8.5).otherwise(10.0)
    turned = F.pmod(q, F.lit(7)) == 0
    glyphs = i.select(
        "doc_id", "page_index", "pos", F.when(F.pmod(q, F.lit(11)) == 0, F.lit(" ")).otherwise(F.col("l_returnflag")).alias("text"), x0.alias("x0"), F.when(turned, y0 + high).otherwise(y0).alias("y0"), (x0 + 6.0).alias("x1"),
        F.when(turned, y0).otherwise(y0 + high).alias("y1"), F.when(q % 2 == 0, 9.0).otherwise(10.0).alias("size"), F.lit("Serif").alias("font"), (q % 3).alias("color"), F.when(F.col("l_discount") > 0.04, 16).otherwise(0).alias("flags"),
        F.array(F.when(F.pmod(q, F.lit(13)) == 0, 0.0).otherwise(1.0), F.lit(0.0)).alias("direction"),
    )
    rounded = [F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return layout.lines(glyphs).select("doc_id", "page_index", "line_id", "text", *rounded, "font_size", "bold")


def irregular_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines at changing distances: whether one goes on with its block hangs on the leading established so far."""
    i = _items(spark, sf)
    # An order is a page here, so that its few lines follow one another downwards.
    rows = i.select(
        F.col("l_orderkey").alias("doc_id"), "page_index", F.col("l_linenumber").alias("line_id"), F.when(F.col("q") % 10 == 0, "1. item").otherwise("words").alias("text"), (F.col("q") % 5 * 10.0).alias("x0"),
        (F.col("l_linenumber") * 17.0 + F.col("q") % 7).alias("y0"), F.when(F.col("q") % 9 == 0, 14.0).otherwise(10.0).alias("font_size"), (F.col("l_discount") > 0.09).alias("bold"), F.col("l_extendedprice").alias("price"),
    )
    one = rows.groupBy("doc_id", "page_index", "line_id").agg(F.min_by(F.struct("text", "x0", "y0", "font_size", "bold"), "price").alias("l")).select("doc_id", "page_index", "line_id", "l.*")
    lines = one.withColumns({"x1": F.col("x0") + 60.0, "y1": F.col("y0") + 10.0})
    return layout.block_lines(lines).select("doc_id", "page_index", "line_id", "block_id")


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    q, n, d = F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_discount") * 100
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geometry.box(q, d, q + n, d + n * 2).alias("a"), F.when(n < 7, geometry.box(n, q, n * 3, F.when(n == 6, F.lit(float("inf"))).otherwise(q + d))).alias("b"))


def _sides(b: Column, name: str) -> list[Column]:
    return [F.round(b[c], 6).alias(f"{name}_{c}") for c in geometry.SIDES]


def box_algebra(spark: SparkSession, sf: str) -> DataFrame:
    rows = _boxes(spark, sf)
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.round(f(a), 6).alias(n) for f, n in ((geometry.width, "width"), (geometry.height, "height"), (geometry.middle_x, "middle_x"), (geometry.middle_y, "middle_y"))),
        F.coalesce(geometry.is_finite(b), F.lit(False)).alias("finite"), *_sides(geometry.grown(a, F.lit(2.0), F.lit(-0.5)), "grown"), *_sides(geometry.union(a, F.when(geometry.is_finite(b), b)), "both"),
    )


def page_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of turned pages as drawn, and the sizes after turning them back."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") + 500).alias("width"), F.lit(842.0).alias("height"), (F.col("l_linenumber") * 90 - 90).alias("rotation"))
    up = geometry.upright(rows)
    again = geometry.restored(up.withColumn("kept", F.col("frame")))
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return again.select(*key, F.col("kept.x1").alias("frame_x1"), F.col("kept.y1").alias("frame_y1"), "width", "height", F.col("rotation").cast("int").alias("rotation"))


def document_failures(spark: SparkSession, sf: str) -> DataFrame:
    """What stops each document on its way to Hindi, the first step first, with what to say about it."""
    routes = catalog.routes(catalog.models(spark)).filter("target = 'hi'").select(F.col("source").alias("lang"), F.lit(True).alias("routed"))
    pages = layout_queries.scan_or_text(spark, sf).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("used_blocks").alias("blocks"), F.bool_or("recognised").alias("tried"), F.bool_or("warned").alias("warned"))
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(F.broadcast(routes), "lang", "left").join(pages, "doc_id", "left")
    count = F.coalesce("pages", F.lit(0)), F.coalesce("blocks", F.lit(0))
    code = failures.first_failure(report.error_code(*count, F.coalesce("tried", F.lit(False))), F.when(F.col("routed").isNull(), "NO_ROUTE"), F.when(F.col("warned"), "OCR_UNAVAILABLE"))
    return failures.described(docs.select("doc_id", code.alias("error_code"))).select("doc_id", "error_code", "soft", "display")


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """One PDF per document with something to draw: its name, pages, and that the file is one."""
    pages = documents.page_commands(document_queries.drawing(document_queries._fitted(spark, sf)))
    files = documents.pdf_files(pages, layout_queries.PAGE_X1, layout_queries.PAGE_Y1)
    name = report.output_name(F.concat(F.lit("/in/doc."), F.col("doc_id").cast("string"), F.lit(".pdf")), F.lit("hi"))
    whole = F.substring("pdf", 1, 5).cast("string") == "%PDF-"
    return files.select("doc_id", name.alias("name"), "page_count", whole.alias("whole"))


def redaction_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What to clear, odd documents as scans on a white ground."""
    white = F.struct(*(F.lit(1.0).alias(c) for c in "rgb"))
    rows = documents.redactions(layout_queries.block_style(spark, sf), F.col("doc_id") % 2 == 1, white)
    return rows.select(*layout.PAGE, "block_id", *_sides(F.col("clear"), "clear"), F.col("fill.r").alias("fill_r"))


def progress_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Overall progress for every event as if its value told how much of a phase is done."""
    phase = F.element_at(F.array(*map(F.lit, ("reading", "translating", "drawing", "saving"))), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.round(tooling.overall_progress(phase, F.col("value") / 100), 6).alias("progress"))


def fonts_to_fetch(spark: SparkSession, sf: str) -> DataFrame:
    return tooling.fonts_to_fetch(catalog.values(spark, [(f,) for f in FONTS_WANTED], "name string"), catalog.values(spark, list(FONTS_PRESENT), "name string, length long"))


def font_signature(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.values(spark, list(FIRST_BYTES), "name string, bytes string")
    return rows.select("name", tooling.is_truetype(F.unhex("bytes")).alias("truetype"))


def first_document(spark: SparkSession, sf: str) -> DataFrame:
    return tooling.first_document(catalog.values(spark, list(enumerate(ARGUMENTS)), "rank int, path string"), catalog.values(spark, [(p,) for p in PRESENT], "path string"))


def start_banners(spark: SparkSession, sf: str) -> DataFrame:
    return tooling.start_banners(catalog_queries.missing_models(spark, sf), F.lit(False))


def restored_pair(spark: SparkSession, sf: str) -> DataFrame:
    return tooling.restored_pair(catalog.values(spark, list(SAVED), "key string, value string"), catalog.languages(spark))


def declared_or_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """Ink and ground of every block: declared on a text layer, sampled on a scan (odd documents)."""
    rows = layout_queries.block_style(spark, sf)
    grey = F.struct(*(F.lit(0.25).alias(c) for c in "rgb")).cast(tooling.ink_type())
    white = F.struct(*(F.lit(1.0).alias(c) for c in "rgb")).cast(tooling.ink_type())
    chosen = tooling.chosen_colour(layout.rgb(F.col("color")).cast(tooling.ink_type()), F.col("doc_id") % 2 == 1, grey, white)
    return rows.select(*layout.PAGE, "block_id", chosen.alias("c")).select(*layout.PAGE, "block_id", F.round("c.ink.b", 6).alias("ink_b"), F.col("c.background.r").alias("ground_r"))


_ITEMS = "it AS (SELECT l_orderkey // 8 AS doc_id, 0 AS page_index, (l_orderkey % 8) * 1000000000000 + l_linenumber * 100000000000 + round(l_extendedprice * 100)::BIGINT AS pos, l_quantity::INT AS q, (l_orderkey % 8)::INT AS line, * FROM lineitem)"
_IRREGULAR = f"""WITH RECURSIVE {_ITEMS},
gl AS (SELECT doc_id, page_index, pos, CASE WHEN q % 11 = 0 THEN ' ' ELSE l_returnflag END AS text, l_linenumber * 9.0::DOUBLE + CASE WHEN q > 40 THEN 30.0 ELSE 0.0 END::DOUBLE + (q % 3) * 1.5::DOUBLE AS x0, line * 7.3::DOUBLE + (q % 5) * 1.1::DOUBLE AS y0,
  CASE WHEN q % 4 = 0 THEN 8.5 ELSE 10.0 END::DOUBLE AS h, CASE WHEN q % 2 = 0 THEN 9.0 ELSE 10.0 END::DOUBLE AS size, l_discount > 0.04 AS bold FROM it WHERE q % 13 <> 0),
un AS (SELECT *, median((y0 + h) - y0) OVER (PARTITION BY doc_id) AS unit, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq FROM gl),
vis AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, coalesce(seq - lag(seq) OVER (PARTITION BY doc_id ORDER BY pos), 1) > 1 AS gone FROM un WHERE text <> ' '),
fold AS (
  SELECT doc_id, k, 0 AS line_id, (y0 + (y0 + h)) / 2 AS mean, 1 AS n, x0 + 6 AS reach, false AS space FROM vis WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN fresh THEN line_id + 1 ELSE line_id END, CASE WHEN fresh THEN m ELSE (mean * n + m) / (n + 1) END, CASE WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN fresh THEN x0 + 6 ELSE greatest(reach, x0 + 6) END,
    NOT fresh AND (gone OR x0 - reach > 0.28 * unit)
  FROM (SELECT v.doc_id, v.k, f.line_id, f.mean, f.n, f.reach, v.gone, v.x0, v.unit, (v.y0 + (v.y0 + v.h)) / 2 AS m, abs((v.y0 + (v.y0 + v.h)) / 2 - f.mean) > 0.5 * v.unit OR v.x0 - f.reach > 2.5 * v.unit AS fresh
    FROM fold f JOIN vis v ON v.doc_id = f.doc_id AND v.k = f.k + 1))
SELECT doc_id, 0 AS page_index, line_id, string_agg(CASE WHEN space THEN ' ' ELSE '' END || text, '' ORDER BY k) AS text, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x0 + 6), 6) AS x1, round(max(y0 + h), 6) AS y1, median(size) AS font_size, avg(bold::INT) > 0.6 AS bold
FROM fold JOIN vis USING (doc_id, k) GROUP BY doc_id, line_id"""
_FOLDED_BLOCKS = """WITH RECURSIVE one AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_id, arg_min({'q': l_quantity::INT, 'd': l_discount}, l_extendedprice) AS l FROM lineitem GROUP BY ALL),
ln AS (SELECT doc_id, line_id, l.q % 10 = 0 AS item, (l.q % 5 * 10)::DOUBLE AS x0, (line_id * 17 + l.q % 7)::DOUBLE AS y0, CASE WHEN l.q % 9 = 0 THEN 14.0 ELSE 10.0 END::DOUBLE AS size, l.d > 0.09 AS bold, row_number() OVER (PARTITION BY doc_id ORDER BY line_id) AS k FROM one),
fold AS (
  SELECT doc_id, k, 0 AS block_id, []::DOUBLE[] AS gaps FROM ln WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN joins THEN block_id ELSE block_id + 1 END, CASE WHEN NOT joins THEN [] WHEN step > 0 THEN list_append(gaps, step) ELSE gaps END
  FROM (SELECT b.doc_id, b.k, f.block_id, f.gaps, b.y0 - a.y0 AS step, NOT b.item AND a.bold = b.bold AND greatest(a.size, b.size) / least(a.size, b.size) < 1.35 AND b.y0 - (a.y0 + 10) > -10
      AND b.y0 - (a.y0 + 10) < 0.85 * coalesce(list_median(f.gaps), 1.2 * a.size) AND (least(a.x0, b.x0) + 60 - greatest(a.x0, b.x0)) / 60 > 0.4 AS joins
    FROM fold f JOIN ln a ON a.doc_id = f.doc_id AND a.k = f.k JOIN ln b ON b.doc_id = f.doc_id AND b.k = f.k + 1))
SELECT doc_id, 0 AS page_index, line_id, block_id FROM fold JOIN ln USING (doc_id, k)"""
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_FAILURES = "failure(error_code, message, recovery, soft) AS (VALUES " + ", ".join(f"({_text(f.code)}, {_text(f.message)}, {_text(f.recovery)}, {str(f.soft).lower()})" for f in failures.FAILURES) + ")"
_PRESENT = "present(path) AS (VALUES " + ", ".join(f"('{p}')" for p in PRESENT) + ")"

QUERIES = {
    f.__name__: f
    for f in (
        irregular_lines, irregular_blocks, box_algebra, page_frames, document_failures, document_files, redaction_rows, progress_shares, fonts_to_fetch, font_signature, first_document, start_banners, restored_pair,
        declared_or_sampled,
    )
}
ORACLES = {
    "irregular_lines": _IRREGULAR,
    "irregular_blocks": _FOLDED_BLOCKS,
    "box_algebra": f"""WITH r AS (SELECT {_KEY}, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + l_linenumber AS x1, l_discount * 100 + l_linenumber * 2 AS y1, l_linenumber < 6 AS finite, l_linenumber::DOUBLE AS bx0, l_quantity AS by0, l_linenumber * 3.0 AS bx1, l_quantity + l_discount * 100 AS by1 FROM lineitem)
SELECT {_KEY}, round(x1 - x0, 6) AS width, round(y1 - y0, 6) AS height, round((x0 + x1) / 2, 6) AS middle_x, round((y0 + y1) / 2, 6) AS middle_y, finite, round(x0 - 2, 6) AS grown_x0, round(y0 + 0.5, 6) AS grown_y0, round(x1 + 2, 6) AS grown_x1, round(y1 - 0.5, 6) AS grown_y1,
  round(CASE WHEN finite THEN least(x0, bx0) ELSE x0 END, 6)::DOUBLE AS both_x0, round(CASE WHEN finite THEN least(y0, by0) ELSE y0 END, 6)::DOUBLE AS both_y0, round(CASE WHEN finite THEN greatest(x1, bx1) ELSE x1 END, 6)::DOUBLE AS both_x1, round(CASE WHEN finite THEN greatest(y1, by1) ELSE y1 END, 6)::DOUBLE AS both_y1 FROM r""",
    "page_frames": f"""WITH r AS (SELECT {_KEY}, l_quantity + 500 AS w, 842.0::DOUBLE AS h, (l_linenumber * 90 - 90) % 360 AS turn FROM lineitem)
SELECT {_KEY}, CASE WHEN turn IN (90, 270) THEN h ELSE w END AS frame_x1, CASE WHEN turn IN (90, 270) THEN w ELSE h END AS frame_y1, w AS width, h AS height, turn::INT AS rotation FROM r""",
    "document_failures": "WITH RECURSIVE " + text_queries._HOPS + ", " + _FAILURES + ", page AS (" + layout_queries.ORACLES["scan_or_text"] + """),
doc AS (SELECT doc_id, count(*) AS pages, sum(used_blocks) AS blocks, bool_or(recognised) AS tried, bool_or(warned) AS warned FROM page GROUP BY doc_id),
code AS (SELECT d.doc_id, CASE WHEN coalesce(pages, 0) = 0 THEN 'NO_PAGES' WHEN coalesce(blocks, 0) = 0 THEN CASE WHEN tried THEN 'NO_TEXT_AFTER_OCR' ELSE 'NO_TEXT' END WHEN hops IS NULL THEN 'NO_ROUTE' WHEN warned THEN 'OCR_UNAVAILABLE' END AS error_code
  FROM documents d LEFT JOIN doc USING (doc_id) LEFT JOIN hops USING (lang))
SELECT doc_id, error_code, soft, CASE WHEN recovery = '' THEN message ELSE message || chr(10) || recovery END AS display FROM code LEFT JOIN failure USING (error_code)""",
    "document_files": f"SELECT doc_id, 'doc.' || doc_id || '.hi.pdf' AS name, count(DISTINCT page_index)::INT AS page_count, true AS whole FROM ({document_queries.ORACLES['draw_rows']}) GROUP BY doc_id",
    "redaction_rows": f"""SELECT doc_id, page_index, block_id, round(x0 - p, 6) AS clear_x0, round(y0 - p, 6) AS clear_y0, round(x1 + p, 6) AS clear_x1, round(y1 + p, 6) AS clear_y1, CASE WHEN doc_id % 2 = 1 THEN 1.0 END::DOUBLE AS fill_r
FROM (SELECT *, CASE WHEN doc_id % 2 = 1 THEN 2.0 ELSE 0.3 END::DOUBLE AS p FROM ({layout_queries.ORACLES['block_style']}))""",
    "progress_shares": """WITH e AS (SELECT event_id, user_id % 4 AS phase, least(greatest(value / 100, 0.0), 1.0) AS s FROM events)
SELECT event_id, round(CASE phase WHEN 0 THEN s * 0.15 WHEN 1 THEN 0.15 + s * 0.7 WHEN 2 THEN 0.85 + s * 0.13 ELSE 0.98 END, 6)::DOUBLE AS progress FROM e""",
    "fonts_to_fetch": "WITH w(name) AS (VALUES " + ", ".join(f"('{f}')" for f in FONTS_WANTED) + "), p(name, length) AS (VALUES " + ", ".join(f"('{f}', {n})" for f, n in FONTS_PRESENT) + ") SELECT name FROM w ANTI JOIN (SELECT * FROM p WHERE length > 1000) USING (name)",
    "font_signature": "WITH f(name, b) AS (VALUES " + ", ".join(f"('{n}', '{b}')" for n, b in FIRST_BYTES) + ") SELECT name, b LIKE '00010000%' AS truetype FROM f",
    "first_document": "WITH a(rank, path) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(ARGUMENTS)) + f"), {_PRESENT} SELECT path FROM a SEMI JOIN present USING (path) WHERE lower(path) LIKE '%.pdf' ORDER BY rank LIMIT 1",
    "start_banners": f"""WITH m AS ({catalog_queries.ORACLES['missing_models']}), n AS (SELECT count(*) AS n, string_agg(directory, ', ' ORDER BY directory) AS names FROM m)
SELECT n || CASE WHEN n = 1 THEN ' translation model is missing' ELSE ' translation models are missing' END AS title, 'Missing: ' || names AS detail FROM n WHERE n > 0
UNION ALL SELECT 'The target script cannot be shaped', 'Characters would stand in the wrong places'""",
    "restored_pair": f"WITH {catalog_queries._LANGS}, saved(key, value) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SAVED) + """), known AS (SELECT saved.* FROM saved JOIN langs ON code = value)
SELECT coalesce((SELECT value FROM known WHERE key = 'source'), (SELECT code FROM langs WHERE menu_order = 0)) AS source, coalesce((SELECT value FROM known WHERE key = 'target'), (SELECT code FROM langs WHERE menu_order = 1)) AS target""",
    "declared_or_sampled": f"SELECT doc_id, page_index, block_id, round(CASE WHEN doc_id % 2 = 1 THEN 0.25 ELSE color / 255 END, 6)::DOUBLE AS ink_b, CASE WHEN doc_id % 2 = 1 THEN 1.0 END::DOUBLE AS ground_r FROM ({layout_queries.ORACLES['block_style']})",
}
