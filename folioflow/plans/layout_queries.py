"""Layout, OCR, fitting and colour queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import colour, fit, layout, ocr
from folioflow.plans.report import document_rollup, summary
from folioflow.sources import glyphs as grid
from folioflow.sources import spread, table

PAGE_X1, PAGE_Y1 = 595.0, 842.0


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def glyph_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Per page: glyphs, visible, bold and italic ones, their box and the sum of blue."""
    g = grid.glyphs(_docs(spark, sf))
    count = lambda c: F.count_if(c)
    flags, font = F.col("flags"), F.col("font")
    return g.groupBy("doc_id", "page_index").agg(
        F.count("*").alias("glyphs"), count(~layout.blank(F.col("text"))).alias("visible"), count(layout.bold(flags, font)).alias("bold"), count(layout.italic(flags, font)).alias("italic"), *layout.box_of(),
        F.sum(layout.rgb(F.col("color"))["b"]).alias("blue"),
    )


def _page_texts(spark: SparkSession, sf: str) -> DataFrame:
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("r", "line"))
    ordered = F.array_sort(F.collect_list(F.struct("r", "line")))
    pages = lines.withColumn("page_index", F.floor(F.col("r") / grid.ROWS).cast("int")).groupBy("doc_id", "page_index")
    return pages.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("page_text"), F.count_if(~layout.blank(F.col("line"))).alias("blocks"))


def text_layer_check(spark: SparkSession, sf: str) -> DataFrame:
    return _page_texts(spark, sf).select("doc_id", "page_index", layout.usable_text_layer(F.col("page_text")).alias("usable"), "blocks")


def scan_or_text(spark: SparkSession, sf: str) -> DataFrame:
    """The recogniser is missing for every third document and finds something in odd ones."""
    pages = _page_texts(spark, sf).withColumn("usable_text", layout.usable_text_layer(F.col("page_text"))).withColumn("ocr_available", F.col("doc_id") % 3 != 0).withColumn("ocr_blocks", F.col("doc_id") % 2)
    return ocr.scan_or_text(pages).select("doc_id", "page_index", "recognised", "warned", "used_blocks", "skipped")


def page_range(spark: SparkSession, sf: str) -> DataFrame:
    """Pages 2 to 3 of every document; documents of one page keep it."""
    pages = _page_texts(spark, sf).select("doc_id", "page_index")
    counted = pages.join(pages.groupBy("doc_id").agg((F.max("page_index") + 1).alias("page_count")), "doc_id")
    return ocr.selected_pages(counted, F.lit(2), F.lit(3)).select("doc_id", "page_index", "page_count")


def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.lines_of_pages(grid.pages(_docs(spark, sf)))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return layout.block_lines(page_lines(spark, sf))


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf).select("doc_id", "page_index", "line_id", "block_id")


def list_items(spark: SparkSession, sf: str) -> DataFrame:
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.filter(layout.starts_list_item(F.col("line"))).select("doc_id", "line_no", "line")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return layout.blocks(_numbered(spark, sf))


def block_text(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("doc_id", "page_index", "block_id", "text", "n_lines")


def block_style(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("doc_id", "page_index", "block_id", "x0", "y0", "x1", "y1", F.round("font_size", 6).alias("font_size"), F.round("line_height", 6).alias("line_height"), "color", "bold", "italic")


def block_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("doc_id", "page_index", "block_id", "alignment")


def ocr_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = ocr.lines(grid.ocr_words(_docs(spark, sf)))
    return found.select("doc_id", "page_num", "block_num", "par_num", "line_num", "line_pos", "text", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "font_size")))


def _room(spark: SparkSession, sf: str) -> DataFrame:
    return fit.available_height(fit.available_width(_blocks(spark, sf), F.lit(PAGE_X1)), F.lit(PAGE_Y1)).drop("_page")


def available_width(spark: SparkSession, sf: str) -> DataFrame:
    return fit.available_width(_blocks(spark, sf), F.lit(PAGE_X1)).select("doc_id", "page_index", "block_id", F.round("available_width", 6).alias("available_width"))


def available_height(spark: SparkSession, sf: str) -> DataFrame:
    return fit.available_height(_blocks(spark, sf), F.lit(PAGE_Y1)).select("doc_id", "page_index", "block_id", F.round("available_height", 6).alias("available_height"))


def _translated(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("translation", F.concat(F.lit("["), "text", F.lit("]")))


def wrap_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = _translated(_blocks(spark, sf)).select("doc_id", "page_index", "block_id", F.posexplode(fit.wrap(F.col("translation"), F.lit(10.0), F.lit(200.0))).alias("line_no", "text"))
    return rows.select("doc_id", "page_index", "block_id", F.col("line_no").cast("long").alias("line_no"), "text")


def _fitted(spark: SparkSession, sf: str) -> DataFrame:
    return fit.fit(_translated(_room(spark, sf)))


def fit_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rounded = (F.round(c, 6).alias(c) for c in ("fit_size", "fit_leading", "fit_height"))
    return _fitted(spark, sf).select("doc_id", "page_index", "block_id", *rounded, F.size("fit_lines").cast("long").alias("n_fit_lines"), "overflowed")


def line_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = fit.line_positions(_fitted(spark, sf))
    return rows.select("doc_id", "page_index", "block_id", F.col("line_no").cast("long").alias("line_no"), "text", F.round("x", 6).alias("x"), F.round("baseline", 6).alias("baseline"))


def layout_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: selected pages, blocks, overflows and the one-line summary."""
    rolled = document_rollup(_page_texts(spark, sf).select("doc_id", "page_index"), _fitted(spark, sf))
    return rolled.select("doc_id", "page_count", "block_count", "overflowed_blocks", summary(F.col("page_count"), F.col("block_count"), F.lit(0), F.lit(0), F.col("overflowed_blocks")).alias("summary"))


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector of ``embeddings`` as a page of 8 by 8 pixels, a colour from each component."""
    at = table(spark, sf, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("i", "x"))
    tone = lambda k: F.floor(F.abs(F.col("x").cast("double")) * k).cast("int") % 256
    return at.select("page", (F.col("i") % 8).alias("px"), F.floor(F.col("i") / 8).cast("int").alias("py"), tone(97).alias("r"), tone(211).alias("g"), tone(53).alias("b"))


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Two boxes a page, a wide and a tall one, that move with the page's number."""
    turn = F.pmod("vec_id", F.lit(4)) * 0.6
    boxes = [(0, 1.2, 3.1, 5.3, 4.2), (1, 3.3, 2.2, 4.1, 5.9)]
    parts = F.array(*(F.struct(F.lit(k).alias("box_id"), *((F.lit(v) + (turn if n[0] == "x" else 0.0)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), sides))) for k, *sides in boxes))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("page"), F.explode(parts).alias("b")).select("page", "b.*")


def dominant_colour(spark: SparkSession, sf: str) -> DataFrame:
    return colour.background(_boxes(spark, sf), _pixels(spark, sf), 1.0).select("page", "box_id", *(F.round(c, 6).alias(c) for c in "rgb"))


def ink_colour(spark: SparkSession, sf: str) -> DataFrame:
    boxes, pixels = _boxes(spark, sf), _pixels(spark, sf)
    return colour.ink(boxes, colour.background(boxes, pixels, 1.0), pixels, 1.0).select("page", "box_id", *(F.round(c, 6).alias(c) for c in "rgb"))


_GAP = r"[\s\x1c-\x1f\p{Z}]"
_MARKER = rf"^([•·‣▪◦⁃∙*]|[-–—]{_GAP}|\(?\p{{Nd}}{{1,2}}[.)]{_GAP}|\(?[a-z][.)]{_GAP}|\(?[ivx]{{1,4}}[.)]{_GAP})"
_LINES_OF = r"ln AS (SELECT doc_id, unnest(range(len(ls))) AS r, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
_GLYPHS = _LINES_OF + r""",
ch AS (SELECT doc_id, r, unnest(range(len(cs))) AS i, unnest(cs) AS text FROM (SELECT doc_id, r, regexp_extract_all(line, '(?s).') AS cs FROM ln)),
g AS (SELECT doc_id, (r // 50)::INT AS page_index, r, i, r * 1000000 + i AS pos, text, (72 + 6 * i + CASE WHEN i >= 60 THEN 60 ELSE 0 END)::DOUBLE AS x0, (100 + 14 * (r % 50))::DOUBLE AS y0,
  (78 + 6 * i + CASE WHEN i >= 60 THEN 60 ELSE 0 END)::DOUBLE AS x1, (110 + 14 * (r % 50))::DOUBLE AS y1, CASE WHEN r = 0 THEN 22.0 ELSE 10.0 END::DOUBLE AS size, CASE WHEN r % 5 = 0 THEN 255 ELSE 0 END AS color,
  r = 0 AS bold, r % 11 = 3 AS italic, NOT regexp_matches(text, '^[\s\x1c-\x1f]$') AS visible FROM ch)"""
_LINES = _GLYPHS + r""",
v AS (SELECT *, lag(i) OVER w AS before, lag(r) OVER (PARTITION BY doc_id, page_index ORDER BY pos) AS above, max(x1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g WHERE visible WINDOW w AS (PARTITION BY doc_id, page_index, r ORDER BY pos)),
b AS (SELECT *, above IS NULL OR above <> r OR x0 - reach > 25 AS fresh FROM v),
n AS (SELECT *, (sum(fresh::INT) OVER (PARTITION BY doc_id, page_index ORDER BY pos) - 1)::INT AS line_id FROM b),
lines AS (SELECT doc_id, page_index, line_id, string_agg(CASE WHEN NOT fresh AND i - before > 1 THEN ' ' ELSE '' END || text, '' ORDER BY pos) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  median(size) AS font_size, min(color) AS color, bool_and(bold) AS bold, bool_and(italic) AS italic FROM n GROUP BY ALL)"""
_NUMBERED = _LINES + r""",
p AS (SELECT *, regexp_matches(text, '@MARKER@') AS item, lag(font_size) OVER w AS s1, lag(bold) OVER w AS b1, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1
  FROM lines WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY line_id)),
numbered AS (SELECT * EXCLUDE (s1, b1, px0, px1, py0, py1, item), (sum((s1 IS NULL OR item OR bold <> b1 OR greatest(font_size, s1) / least(font_size, s1) >= 1.35 OR NOT (y0 - py1 > py0 - py1 AND y0 - py1 < 0.85 * 1.2 * s1)
    OR NOT ((least(x1, px1) - greatest(x0, px0)) / least(x1 - x0, px1 - px0) > 0.4))::INT) OVER (PARTITION BY doc_id, page_index ORDER BY line_id) - 1)::INT AS block_id FROM p)""".replace("@MARKER@", _MARKER)
_BLOCKS = _NUMBERED + r""",
q AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY doc_id, page_index, block_id ORDER BY y0, line_id) AS gap, line_id = max(line_id) OVER (PARTITION BY doc_id, page_index, block_id) AS last FROM numbered),
heavy AS (SELECT doc_id, page_index, block_id, arg_max(color, (w, -f)) AS color FROM (SELECT doc_id, page_index, block_id, color, sum(length(text)) AS w, min(line_id) AS f FROM numbered GROUP BY ALL) GROUP BY ALL),
bl AS (SELECT doc_id, page_index, block_id, list(text ORDER BY line_id) AS ts, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, median(font_size) AS font_size,
  coalesce(CASE WHEN count(*) < 2 THEN max(y1) - min(y0) ELSE median(gap) FILTER (gap > 0) END, 1.2 * median(font_size)) AS line_height,
  coalesce(sum(length(text)) FILTER (bold), 0) / sum(length(text)) > 0.6 AS bold, coalesce(sum(length(text)) FILTER (italic), 0) / sum(length(text)) > 0.6 AS italic,
  max(x0) - min(x0) AS l, max((x0 + x1) / 2) - min((x0 + x1) / 2) AS c, CASE WHEN count(*) >= 3 THEN max(x1) FILTER (NOT last) - min(x1) FILTER (NOT last) ELSE max(x1) - min(x1) END AS r, 0.6 * median(font_size) AS tol FROM q GROUP BY ALL),
blocks AS (SELECT bl.*, heavy.color, CASE WHEN n_lines < 2 OR l <= tol THEN 'left' WHEN c <= tol AND c < r THEN 'centre' WHEN r <= tol THEN 'right' ELSE 'left' END AS alignment,
  list_reduce(ts, lambda done_, line_: CASE WHEN done_ LIKE '%-' AND done_ NOT LIKE '%--' THEN left(done_, -1) || line_ ELSE done_ || ' ' || line_ END) AS text FROM bl JOIN heavy USING (doc_id, page_index, block_id))"""
_ROOM = _BLOCKS + r""",
wide AS (SELECT b.doc_id, b.page_index, b.block_id, min(o.x0) AS edge FROM blocks b JOIN blocks o ON b.doc_id = o.doc_id AND b.page_index = o.page_index AND b.block_id <> o.block_id AND o.x0 >= b.x1 AND o.y1 > b.y0 AND o.y0 < b.y1 GROUP BY ALL),
deep AS (SELECT b.doc_id, b.page_index, b.block_id, min(o.y0) AS edge FROM blocks b JOIN blocks o ON b.doc_id = o.doc_id AND b.page_index = o.page_index AND b.block_id <> o.block_id AND o.y0 >= b.y1 AND o.x1 > b.x0 AND o.x0 < b.x1 GROUP BY ALL),
room AS (SELECT b.*, CASE WHEN n_lines > 1 THEN greatest(x1 - x0, 1.0) ELSE greatest(x1 - x0, coalesce(wide.edge, 595.0) - x0 - 6.0, 1.0) END AS aw,
  greatest(y1 - y0, least(coalesce(deep.edge, 842.0) - y0 - line_height * 0.25, (y1 - y0) * 2.2)) AS ah, '[' || text || ']' AS tr FROM blocks b LEFT JOIN wide USING (doc_id, page_index, block_id) LEFT JOIN deep USING (doc_id, page_index, block_id))"""


def _wrapped(text: str, size: str, width: str) -> str:
    """A fold that wraps ``text`` greedily; gives a list of lines."""
    each = f"greatest(floor({width} / ({size} * 0.5))::INT, 1)"
    cut = f"[substring(wd_.cur, k, {each}) FOR k IN range(1, length(wd_.cur) + 1, {each})]"
    fold = f"""list_reduce([{{'c': []::VARCHAR[], 'cur': ''}}] || [{{'c': []::VARCHAR[], 'cur': x}} FOR x IN string_split({text}, ' ')], lambda st_, wd_:
  CASE WHEN st_.cur <> '' AND length(st_.cur || ' ' || wd_.cur) * {size} * 0.5 <= {width} THEN {{'c': st_.c, 'cur': st_.cur || ' ' || wd_.cur}}
  WHEN length(wd_.cur) * {size} * 0.5 > {width} THEN {{'c': CASE WHEN st_.cur = '' THEN st_.c ELSE st_.c || [st_.cur] END || list_slice({cut}, 1, -2), 'cur': list_extract({cut}, -1)}}
  ELSE {{'c': CASE WHEN st_.cur = '' THEN st_.c ELSE st_.c || [st_.cur] END, 'cur': wd_.cur}} END)"""
    return f"(({fold}).c || [({fold}).cur])"


_FIT = _ROOM + r""",
s0 AS (SELECT *, greatest(font_size, 1.0) AS st, least(greatest(font_size, 1.0), greatest(greatest(font_size, 1.0) * 0.62, 5.0)) AS fl, greatest(greatest(font_size, 1.0) * 0.04, 0.25) AS sp FROM room),
s1 AS (SELECT *, unnest(range(0, floor((st - fl) / sp + 1e-9)::INT + 2)) AS k FROM s0),
s2 AS (SELECT *, k = floor((st - fl) / sp + 1e-9)::INT + 1 AS over, CASE WHEN k = floor((st - fl) / sp + 1e-9)::INT + 1 THEN fl ELSE st - k * sp END AS sz FROM s1),
s3 AS (SELECT *, """ + _wrapped("tr", "sz", "aw") + r""" AS fit_lines, greatest(line_height * sz / greatest(st, 0.01), sz * 1.05) AS lead FROM s2),
s4 AS (SELECT *, lead * (len(fit_lines) - 1) + sz * (0.8 + 0.2) AS hgt FROM s3),
fitted AS (SELECT * FROM s4 WHERE over OR hgt <= ah QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, block_id ORDER BY k) = 1)"""

_PAGES = _LINES_OF + r""",
pg AS (SELECT doc_id, (r // 50)::INT AS page_index, string_agg(line, chr(10) ORDER BY r) AS t, count(*) FILTER (NOT regexp_matches(line, '^[\s\x1c-\x1f]*$')) AS blocks FROM ln GROUP BY ALL),
pu AS (SELECT *, length(regexp_replace(t, '[\s\x1c-\x1f]', '', 'g')) >= 12 AS usable FROM pg)"""

_COLOUR = r"""
pixels AS (SELECT vec_id AS page, i % 8 AS px, i // 8 AS py, floor(abs(x) * 97)::INT % 256 AS r, floor(abs(x) * 211)::INT % 256 AS g, floor(abs(x) * 53)::INT % 256 AS bl
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)),
boxes AS (SELECT vec_id AS page, box_id, x0 + (vec_id % 4) * 0.6::DOUBLE AS x0, y0, x1 + (vec_id % 4) * 0.6::DOUBLE AS x1, y1 FROM embeddings, (VALUES (0, 1.2::DOUBLE, 3.1::DOUBLE, 5.3::DOUBLE, 4.2::DOUBLE), (1, 3.3, 2.2, 4.1, 5.9)) b(box_id, x0, y0, x1, y1)),
ring AS (
  SELECT page, box_id, side * 100000 + k AS seq, x0 + k * greatest((x1 - x0) / 12, 1.0) AS x, CASE side WHEN 0 THEN y0 - greatest((y1 - y0) * 0.35, 3.0) ELSE y1 + greatest((y1 - y0) * 0.35, 3.0) END AS y
  FROM boxes, range(0, 2) a(side), range(0, 20) b(k) WHERE k <= floor((x1 - x0) / greatest((x1 - x0) / 12, 1.0) + 1e-9)
  UNION ALL SELECT page, box_id, side * 100000 + k, CASE side WHEN 2 THEN x0 - greatest((y1 - y0) * 0.35, 3.0) ELSE x1 + greatest((y1 - y0) * 0.35, 3.0) END, y0 + k * greatest((y1 - y0) / 6, 1.0)
  FROM boxes, range(2, 4) a(side), range(0, 20) b(k) WHERE k <= floor((y1 - y0) / greatest((y1 - y0) / 6, 1.0) + 1e-9)),
hit AS (SELECT ring.*, r, g, bl FROM ring JOIN pixels USING (page) WHERE px = round_even(x, 0)::INT AND py = round_even(y, 0)::INT),
bucket AS (SELECT page, box_id, count(*) AS n, min(seq) AS f, avg(r) AS r, avg(g) AS g, avg(bl) AS b FROM hit GROUP BY page, box_id, r // 16, g // 16, bl // 16),
ground AS (SELECT page, box_id, coalesce(r / 255, 1.0) AS r, coalesce(g / 255, 1.0) AS g, coalesce(b / 255, 1.0) AS b FROM boxes LEFT JOIN (SELECT * FROM bucket QUALIFY row_number() OVER (PARTITION BY page, box_id ORDER BY n DESC, f) = 1) USING (page, box_id))"""
_INK = _COLOUR + r""",
stp AS (SELECT *, greatest(1.0, greatest(x1 - x0, 1.0) / 64) AS sx, greatest(1.0, greatest(y1 - y0, 1.0) / 64) AS sy FROM boxes),
pt AS (SELECT page, box_id, i * 100000 + j AS seq, x0 + j * sx AS x, y0 + i * sy AS y FROM stp, range(0, 9) a(i), range(0, 9) b(j) WHERE i <= floor((y1 - y0) / sy + 1e-9) AND j <= floor((x1 - x0) / sx + 1e-9)),
inside AS (SELECT pt.*, r, g, bl, (r * 299 + g * 587 + bl * 114) // 1000 AS luma FROM pt JOIN pixels USING (page) WHERE px = round_even(x, 0)::INT AND py = round_even(y, 0)::INT),
pick AS (SELECT i.*, row_number() OVER (PARTITION BY i.page, i.box_id ORDER BY CASE WHEN 0.299 * gr.r + 0.587 * gr.g + 0.114 * gr.b > 0.5 THEN luma ELSE -luma END, seq) AS k FROM inside i JOIN ground gr USING (page, box_id))"""
_KEY = "SELECT doc_id, page_index, block_id"

QUERIES = {
    f.__name__: f
    for f in (
        glyph_predicates, text_layer_check, scan_or_text, page_range, page_lines, page_blocks, list_items, block_text, block_style, block_alignment, ocr_lines, available_width, available_height, wrap_lines, fit_blocks,
        line_positions, layout_report, dominant_colour, ink_colour,
    )
}
ORACLES = {
    "glyph_predicates": f"WITH {_GLYPHS} SELECT doc_id, page_index, count(*) AS glyphs, count(*) FILTER (visible) AS visible, count(*) FILTER (bold) AS bold, count(*) FILTER (italic) AS italic, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum(color / 255) AS blue FROM g GROUP BY ALL",
    "text_layer_check": f"WITH {_PAGES} SELECT doc_id, page_index, usable, blocks FROM pu",
    "scan_or_text": f"""WITH {_PAGES}, d AS (SELECT *, blocks = 0 OR NOT usable AS needs, doc_id % 3 <> 0 AS av, doc_id % 2 AS ob FROM pu), e AS (SELECT *, needs AND av AND ob > 0 AS recognised FROM d)
SELECT doc_id, page_index, recognised, needs AND NOT av AS warned, CASE WHEN recognised THEN ob ELSE blocks END AS used_blocks, CASE WHEN recognised THEN ob ELSE blocks END = 0 AS skipped FROM e""",
    "page_range": f"WITH {_PAGES}, c AS (SELECT doc_id, page_index, (max(page_index) OVER (PARTITION BY doc_id) + 1)::INT AS page_count FROM pg) SELECT doc_id, page_index, page_count FROM c WHERE page_count < 2 OR page_index BETWEEN 1 AND 2",
    "page_lines": f"WITH {_LINES} SELECT * FROM lines",
    "page_blocks": f"WITH {_NUMBERED} SELECT doc_id, page_index, line_id, block_id FROM numbered",
    "list_items": f"WITH {_LINES_OF} SELECT doc_id, r::INT AS line_no, line FROM ln WHERE regexp_matches(regexp_replace(line, '^{_GAP}+|{_GAP}+$', '', 'g'), '{_MARKER}')",
    "block_text": f"WITH {_BLOCKS} {_KEY}, text, n_lines FROM blocks",
    "block_style": f"WITH {_BLOCKS} {_KEY}, x0, y0, x1, y1, round(font_size, 6) AS font_size, round(line_height, 6) AS line_height, color, bold, italic FROM blocks",
    "block_alignment": f"WITH {_BLOCKS} {_KEY}, alignment FROM blocks",
    "ocr_lines": r"""WITH w AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS raw FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
k AS (SELECT *, pos // 8 AS ln, pos % 8 AS slot, length(raw) * 25 AS wd, regexp_replace(raw, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g') AS text FROM w WHERE pos % 97 <> 0 AND (doc_id * 37 + pos * 17) % 101 >= 40),
a AS (SELECT doc_id, (ln // 20 + 1)::INT AS block_num, (ln + 1)::INT AS line_num, min(pos) AS line_pos, string_agg(text, ' ' ORDER BY pos) AS text, min(slot * 300 / (300 / 72)) AS x0, min(ln * 60 / (300 / 72)) AS y0,
  max((slot * 300 + wd) / (300 / 72)) AS x1, max((ln * 60 + 50) / (300 / 72)) AS y1 FROM k WHERE text <> '' GROUP BY doc_id, ln)
SELECT doc_id, 1 AS page_num, block_num, 1 AS par_num, line_num, line_pos, text, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1,
  round(greatest((y1 - y0) * CASE WHEN regexp_matches(text, '[\p{Lu}bdfhklt0-9]') AND regexp_matches(text, '[gjpqy,;()\[\]{}/\\]') THEN 1.07 ELSE 1.32 END, 1.0), 6) AS font_size FROM a""",
    "available_width": f"WITH {_ROOM} {_KEY}, round(aw, 6) AS available_width FROM room",
    "available_height": f"WITH {_ROOM} {_KEY}, round(ah, 6) AS available_height FROM room",
    "wrap_lines": f"WITH {_BLOCKS}, w AS ({_KEY}, {_wrapped(chr(39) + '[' + chr(39) + ' || text || ' + chr(39) + ']' + chr(39), '10.0::DOUBLE', '200.0::DOUBLE')} AS ls FROM blocks) {_KEY}, unnest(range(len(ls))) AS line_no, unnest(ls) AS text FROM w",
    "fit_blocks": f"WITH {_FIT} {_KEY}, round(sz, 6) AS fit_size, round(lead, 6) AS fit_leading, round(hgt, 6) AS fit_height, len(fit_lines) AS n_fit_lines, over AS overflowed FROM fitted",
    "line_positions": f"""WITH {_FIT}, u AS (SELECT *, unnest(range(len(fit_lines))) AS line_no, unnest(fit_lines) AS line FROM fitted)
{_KEY}, line_no, line AS text, round(CASE alignment WHEN 'centre' THEN x0 + greatest(x1 - x0 - length(line) * sz * 0.5, 0.0) / 2 WHEN 'right' THEN x1 - length(line) * sz * 0.5 ELSE x0 END, 6) AS x, round(y0 + sz * 0.8 + line_no * lead, 6) AS baseline FROM u WHERE line <> ''""",
    "layout_report": f"""WITH {_FIT}, pc AS (SELECT doc_id, count(DISTINCT (r // 50)) AS page_count FROM ln GROUP BY doc_id), bc AS (SELECT doc_id, count(*) AS n, count(*) FILTER (over) AS o FROM fitted GROUP BY doc_id),
z AS (SELECT doc_id, page_count, coalesce(n, 0) AS block_count, coalesce(o, 0) AS overflowed_blocks FROM pc LEFT JOIN bc USING (doc_id))
SELECT *, concat_ws(' · ', page_count || CASE WHEN page_count = 1 THEN ' page' ELSE ' pages' END, block_count || CASE WHEN block_count = 1 THEN ' block' ELSE ' blocks' END || ' translated', CASE WHEN overflowed_blocks > 0 THEN overflowed_blocks || ' block(s) were too long to fit and run on' END) AS summary FROM z""",
    "dominant_colour": f"WITH {_COLOUR} SELECT page, box_id, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM ground",
    "ink_colour": f"WITH {_INK} SELECT page, box_id, round(r / 255, 6) AS r, round(g / 255, 6) AS g, round(bl / 255, 6) AS b FROM pick WHERE k = 1",
}
