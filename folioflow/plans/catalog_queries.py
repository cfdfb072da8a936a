"""Catalog, routing, font and report queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import catalog, ocr
from folioflow.plans import layout_queries, report
from folioflow.sources import spread, table

#: A model folder in which one model lacks a file, and font folders by rank.
MODEL_LISTING = [(d, f) for d in ("opus-mt-en-de", "opus-mt-de-en", "opus-mt-en-hi", "opus-mt-hi-en") for f in ("model.bin", "source.spm", "target.spm", "config.json") if (d, f) != ("opus-mt-hi-en", "target.spm")]
FONT_LISTING = [(0, "/sys", "Arial.TTF"), (0, "/sys", "arialbd.ttf"), (1, "/user", "arial.ttf"), (1, "/user", "Zapf.otf"), (2, "/app", "NotoSansDevanagari-Regular.ttf"), (2, "/app", "notes.txt")]


OCR_LISTING = ("List of available languages (3):", "eng", " deu ", "", "osd", "two words")


def _model_listing(spark: SparkSession) -> DataFrame:
    return catalog.values(spark, MODEL_LISTING, "directory string, file string")


def _installed_models(spark: SparkSession) -> DataFrame:
    models = catalog.models(spark)
    return models.join(catalog.installed(_model_listing(spark)), "directory", "left_semi").select("ord", "directory", "source", "target")


def language_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's language code, spelt with case and spaces, against the registry."""
    codes = table(spark, sf, "documents").select("doc_id", F.concat(F.lit(" "), F.upper("lang"), F.lit("\t")).alias("code"))
    found = catalog.named(codes, catalog.languages(spark))
    return found.select("doc_id", "english_name", "script", "ocr_code", F.coalesce(F.col("script") == "devanagari", F.lit(False)).alias("needs_shaping"))


def first_other_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return catalog.first_other_than(F.col("lang"), catalog.languages(spark), docs).select("doc_id", catalog.pair_key(F.col("lang"), F.col("other")).alias("pair"))


def model_lookup(spark: SparkSession, sf: str) -> DataFrame:
    langs = table(spark, sf, "documents").select(F.col("lang").alias("source")).distinct()
    pairs = langs.crossJoin(F.broadcast(catalog.languages(spark).select(F.col("code").alias("target"))))
    return catalog.model_for(pairs, catalog.models(spark)).select("source", "target", "directory", (F.col("source") == F.col("target")).alias("is_identity"))


def missing_models(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.missing(catalog.models(spark), _model_listing(spark)).select("directory", "source", "target")


def route_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.route_matrix(catalog.languages(spark), _installed_models(spark))


def route_paths(spark: SparkSession, sf: str) -> DataFrame:
    found = catalog.routes(catalog.models(spark))
    return found.select("source", "target", F.array_join("route", ",").alias("route"), catalog.route_note(F.size("route")).alias("note"))


def reachable_targets(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.reachable_targets(catalog.languages(spark), _installed_models(spark)).select("source", F.array_join("targets", ",").alias("targets"))


def font_choice(spark: SparkSession, sf: str) -> DataFrame:
    listing = catalog.values(spark, FONT_LISTING, "dir_rank int, directory string, file string")
    return catalog.font_choice(listing).withColumn("alias", catalog.font_alias(F.col("regular")))


def ocr_support(spark: SparkSession, sf: str) -> DataFrame:
    lines = catalog.values(spark, list(enumerate(OCR_LISTING)), "pos int, line string")
    have = catalog.ocr_languages(lines).agg(F.collect_set("code").alias("have"))
    return catalog.languages(spark).crossJoin(F.broadcast(have)).select("code", catalog.supports(F.col("ocr_code"), F.col("have")).alias("supported"))


def scan_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: recognised and skipped pages, the error code and the output name."""
    pages = layout_queries.scan_or_text(spark, sf)
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("used_blocks").alias("blocks"), F.bool_or("recognised").alias("tried"))
    out = report.page_lists(pages).join(totals, "doc_id")
    name = report.output_name(F.concat(F.lit("/in/doc."), F.col("doc_id").cast("string"), F.lit(".pdf")), F.lit("hi"))
    return out.select(
        "doc_id", F.array_join("recognised_pages", ",").alias("recognised_pages"), F.array_join("skipped_pages", ",").alias("skipped_pages"), report.used_ocr(F.col("recognised_pages")).alias("used_ocr"),
        report.error_code(F.col("pages"), F.col("blocks"), F.col("tried")).alias("error_code"), name.alias("output_name"),
    )


def tsv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Recogniser output as one TSV text per document, parsed again and made into lines."""
    from folioflow.sources.glyphs import ocr_words

    fields = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]
    words = ocr_words(spread(table(spark, sf, "documents")).select("doc_id", F.regexp_replace("text", r"[\t\r\n]", " ").alias("text")))
    row = F.concat_ws("\t", *fields)
    tsv = F.concat(F.lit("\t".join(fields) + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))), lambda x: x["row"]), "\n"), F.lit("\n"))
    parsed = ocr.parse_tsv(words.groupBy("doc_id").agg(tsv.alias("tsv")))
    rows = parsed.select("doc_id", "pos", *(F.col("fields")[f].alias(f) for f in fields))
    return ocr.lines(rows).select("doc_id", "block_num", "line_num", "line_pos", "text", F.round("x1", 6).alias("x1"), F.round("font_size", 6).alias("font_size"))


_LANGS = "langs(menu_order, code, english_name, script, ocr_code) AS (VALUES (0, 'en', 'English', 'latin', 'eng'), (1, 'de', 'German', 'latin', 'deu'), (2, 'hi', 'Hindi', 'devanagari', 'hin'))"
_MODELS = "models(ord, directory, source, target) AS (VALUES (0, 'opus-mt-en-de', 'en', 'de'), (1, 'opus-mt-de-en', 'de', 'en'), (2, 'opus-mt-en-hi', 'en', 'hi'), (3, 'opus-mt-hi-en', 'hi', 'en'))"
_FONTS = "wanted(script, weight, rank, key) AS (VALUES " + ", ".join(f"('{s}', '{w}', {i}, '{f.lower()}')" for (s, w), files in catalog.FONTS.items() for i, f in enumerate(files)) + ")"
_FILES = "files(directory, file) AS (VALUES " + ", ".join(f"('{d}', '{f}')" for d, f in MODEL_LISTING) + ")"
_INSTALLED = _MODELS + ", " + _FILES + ", whole AS (SELECT directory FROM files WHERE file IN ('model.bin', 'source.spm', 'target.spm') GROUP BY directory HAVING count(DISTINCT file) = 3), have AS (SELECT * FROM models SEMI JOIN whole USING (directory))"


def _walk(edges: str) -> str:
    return f"""walk(source, target, seen, path, dirs) AS (
  SELECT n, n, [n], []::INT[], []::VARCHAR[] FROM (SELECT source AS n FROM {edges} UNION SELECT target FROM {edges})
  UNION ALL SELECT w.source, m.target, list_append(w.seen, m.target), list_append(w.path, m.ord), list_append(w.dirs, m.directory) FROM walk w JOIN {edges} m ON m.source = w.target WHERE NOT list_contains(w.seen, m.target)),
routes AS (SELECT source, target, dirs AS route FROM walk QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY len(path), path) = 1)"""


QUERIES = {
    f.__name__: f
    for f in (language_lookup, first_other_language, model_lookup, missing_models, route_matrix, route_paths, reachable_targets, font_choice, ocr_support, scan_report, tsv_lines)
}
ORACLES = {
    "language_lookup": f"WITH {_LANGS} SELECT doc_id, english_name, script, ocr_code, coalesce(script = 'devanagari', false) AS needs_shaping FROM documents LEFT JOIN langs ON code = lang",
    "first_other_language": f"WITH {_LANGS} SELECT doc_id, lang || '->' || (SELECT arg_min(code, menu_order) FROM langs WHERE code <> lang) AS pair FROM documents",
    "model_lookup": f"WITH {_LANGS}, {_MODELS}, l AS (SELECT DISTINCT lang FROM documents) SELECT lang AS source, code AS target, directory, lang = code AS is_identity FROM l CROSS JOIN langs LEFT JOIN models ON source = lang AND target = code",
    "missing_models": f"WITH {_INSTALLED} SELECT directory, source, target FROM models ANTI JOIN whole USING (directory)",
    "route_matrix": f"WITH RECURSIVE {_LANGS}, {_INSTALLED}, {_walk('have')} SELECT a.code AS source, b.code AS target, coalesce(len(route) > 0, false) AS has_route, coalesce(len(route) > 1, false) AS pivots, len(route)::INT AS hops FROM langs a JOIN langs b ON a.code <> b.code LEFT JOIN routes r ON r.source = a.code AND r.target = b.code",
    "route_paths": f"WITH RECURSIVE {_MODELS}, {_walk('models')} SELECT source, target, array_to_string(route, ',') AS route, CASE WHEN len(route) > 1 THEN 'via pivot' ELSE '' END AS note FROM routes",
    "reachable_targets": f"WITH RECURSIVE {_LANGS}, {_INSTALLED}, {_walk('have')} SELECT source, string_agg(target, ',' ORDER BY menu_order) AS targets FROM routes JOIN langs ON code = target WHERE source <> target GROUP BY source",
    "font_choice": f"""WITH {_FONTS}, files(dir_rank, directory, file) AS (VALUES {', '.join(map(str, FONT_LISTING))}),
found AS (SELECT lower(file) AS key, directory || '/' || file AS path FROM files WHERE regexp_matches(lower(file), '[.](ttf|otf|ttc)$') QUALIFY row_number() OVER (PARTITION BY lower(file) ORDER BY dir_rank, directory || '/' || file) = 1),
best AS (SELECT script, arg_min(path, rank) FILTER (weight = 'regular' AND path IS NOT NULL) AS r, arg_min(path, rank) FILTER (weight = 'bold' AND path IS NOT NULL) AS b FROM wanted LEFT JOIN found USING (key) GROUP BY script),
chosen AS (SELECT script, b, coalesce(r, CASE WHEN script = 'latin' THEN (SELECT min(path) FROM found) END) AS regular FROM best)
SELECT script, regular, coalesce(b, regular) AS bold_or_regular, CASE WHEN regular IS NULL THEN 'FONT_NOT_FOUND' END AS error_code, 'F' || left(regexp_replace(regexp_extract(regular, '([^/]*)[.][^.]*$', 1), '[^0-9A-Za-z]', '', 'g'), 24) AS alias FROM chosen""",
    "ocr_support": f"""WITH {_LANGS}, listing(pos, line) AS (VALUES {', '.join(map(str, enumerate(OCR_LISTING)))}), have AS (SELECT trim(line) AS code FROM listing WHERE pos >= 1 AND trim(line) <> '' AND NOT contains(trim(line), ' '))
SELECT code, ocr_code IN (SELECT code FROM have) AS supported FROM langs""",
    "scan_report": layout_queries.ORACLES["scan_or_text"].replace("\nSELECT doc_id, page_index", ", f AS (SELECT doc_id, page_index", 1) + """ FROM_E)
SELECT doc_id, coalesce(string_agg((page_index + 1)::VARCHAR, ',' ORDER BY page_index) FILTER (recognised), '') AS recognised_pages, coalesce(string_agg((page_index + 1)::VARCHAR, ',' ORDER BY page_index) FILTER (skipped), '') AS skipped_pages,
  bool_or(recognised) AS used_ocr, CASE WHEN sum(used_blocks) = 0 THEN CASE WHEN bool_or(recognised) THEN 'NO_TEXT_AFTER_OCR' ELSE 'NO_TEXT' END END AS error_code, 'doc.' || doc_id || '.hi.pdf' AS output_name FROM f GROUP BY doc_id""",
    "tsv_lines": layout_queries.ORACLES["ocr_lines"].replace("string_split(text, ' ') AS ws", "string_split(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), ' ') AS ws"),
}
ORACLES["scan_report"] = ORACLES["scan_report"].replace(" FROM e FROM_E)", " FROM e)")
ORACLES["tsv_lines"] = f"SELECT doc_id, block_num, line_num, line_pos, text, x1, font_size FROM ({ORACLES['tsv_lines']})"
