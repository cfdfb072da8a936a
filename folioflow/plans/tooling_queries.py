"""Queries over the small steps of ``operators.tooling``, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import catalog, fit, tooling
from folioflow.plans import catalog_queries, layout_queries
from folioflow.sources import table

VERSIONS = ("1.2", "2", "3.4.5.6.7", "1.0rc1.x", "0.9.1")
FILES = [("/m/a/model.bin", 500), ("/m/a/source.spm", 40), ("/m/b/model.bin", 700), ("/x.txt", 3)]


def selection_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every state of the two pickers, and what each choice of a source or a target makes of it."""
    codes = catalog.languages(spark).select("code")
    state = codes.select(F.col("code").alias("s")).crossJoin(codes.select(F.col("code").alias("t"))).filter("s <> t").crossJoin(codes.select(F.col("code").alias("chosen")))
    a, b = tooling.after_choice("source", F.col("chosen"), F.col("s"), F.col("t")), tooling.after_choice("target", F.col("chosen"), F.col("s"), F.col("t"))
    return state.select("s", "t", "chosen", catalog.pair_key(a["source"], a["target"]).alias("by_source"), catalog.pair_key(b["source"], b["target"]).alias("by_target"), catalog.pair_key(F.col("t"), F.col("s")).alias("swapped"))


def version_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.values(spark, [(v,) for v in VERSIONS], "version string")
    return rows.select("version", F.array_join(tooling.version_parts(F.col("version")), ", ").alias("parts"))


def directory_size(spark: SparkSession, sf: str) -> DataFrame:
    return tooling.directory_size(catalog.values(spark, FILES, "path string, length long"))


def wanted_data(spark: SparkSession, sf: str) -> DataFrame:
    return tooling.wanted_data(catalog.values(spark, [("eng",), ("osd",), ("fra",), ("eng",)], "code string"))


def character_counter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tooling.counter(F.col("text")).alias("counter"))


def missing_banner(spark: SparkSession, sf: str) -> DataFrame:
    return tooling.banner(catalog_queries.missing_models(spark, sf))


def self_test(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of the set-up and of the data as rows: name, passed, severity, detail."""
    docs = table(spark, sf, "documents")
    return tooling.self_test([
        ("models", catalog_queries.missing_models(spark, sf), F.lit(False), "every model has its files", True),
        ("routes", catalog_queries.route_matrix(spark, sf), F.col("has_route"), "every pair has a route", True),
        ("fonts", catalog_queries.font_choice(spark, sf), F.col("error_code").isNull(), "every script has a font", True),
        ("recognition", catalog_queries.ocr_support(spark, sf), F.col("supported"), "every language can be recognised", False),
        ("texts", docs, F.col("text").isNotNull(), "every document has a text", True),
        ("sizes", docs, F.col("n_chars") == F.length("text"), "sizes are those of the texts", False),
    ])


def redaction_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """What to clear before drawing, with odd documents taken as scans."""
    rows = layout_queries.block_style(spark, sf)
    box = fit.redaction_box({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, F.col("doc_id") % 2 == 1)
    return rows.select("doc_id", "page_index", "block_id", box.alias("b")).select("doc_id", "page_index", "block_id", *(F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


_STATES = "c(code, k) AS (VALUES ('en', 0), ('de', 1), ('hi', 2)), st AS (SELECT a.code AS s, b.code AS t, d.code AS chosen, (SELECT arg_min(code, k) FROM c WHERE code <> d.code) AS alt FROM c a JOIN c b ON a.code <> b.code CROSS JOIN c d)"

QUERIES = {f.__name__: f for f in (selection_rules, version_parts, directory_size, wanted_data, character_counter, missing_banner, self_test, redaction_boxes)}
ORACLES = {
    "selection_rules": f"WITH {_STATES} SELECT s, t, chosen, chosen || '->' || CASE WHEN t = chosen THEN alt ELSE t END AS by_source, CASE WHEN s = chosen THEN alt ELSE s END || '->' || chosen AS by_target, t || '->' || s AS swapped FROM st",
    "version_parts": "WITH v(version) AS (VALUES " + ", ".join(f"('{v}')" for v in VERSIONS) + ") SELECT version, array_to_string([CASE WHEN regexp_full_match(p, '[0-9]+') THEN p ELSE '0' END FOR p IN (string_split(version, '.') || ['0', '0', '0'])[1:4]], ', ') AS parts FROM v",
    "directory_size": "WITH f(path, length) AS (VALUES " + ", ".join(f"('{p}', {n}::BIGINT)" for p, n in FILES) + ") SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, count(*) AS files, sum(length)::BIGINT AS bytes FROM f GROUP BY 1",
    "wanted_data": f"WITH {catalog_queries._LANGS}, have(code) AS (VALUES ('eng'), ('osd'), ('fra'), ('eng')), w AS (SELECT ocr_code AS code FROM langs UNION ALL SELECT 'osd') SELECT code, code IN (SELECT code FROM have) AS present FROM w",
    "character_counter": "SELECT doc_id, length(coalesce(text, '')) || CASE WHEN length(coalesce(text, '')) = 1 THEN ' character' ELSE ' characters' END AS counter FROM documents",
    "missing_banner": f"SELECT string_agg(directory, ', ' ORDER BY directory) AS missing FROM ({catalog_queries.ORACLES['missing_models']})",
    "self_test": f"""SELECT 'models' AS name, count(*) = 0 AS passed, CASE WHEN count(*) = 0 THEN 'ok' ELSE 'FAIL' END AS severity, 'every model has its files' AS detail FROM ({catalog_queries.ORACLES['missing_models']})
UNION ALL SELECT 'routes', bool_and(has_route), CASE WHEN bool_and(has_route) THEN 'ok' ELSE 'FAIL' END, 'every pair has a route' FROM ({catalog_queries.ORACLES['route_matrix']})
UNION ALL SELECT 'fonts', bool_and(error_code IS NULL), CASE WHEN bool_and(error_code IS NULL) THEN 'ok' ELSE 'FAIL' END, 'every script has a font' FROM ({catalog_queries.ORACLES['font_choice']})
UNION ALL SELECT 'recognition', bool_and(supported), CASE WHEN bool_and(supported) THEN 'ok' ELSE 'warn' END, 'every language can be recognised' FROM ({catalog_queries.ORACLES['ocr_support']})
UNION ALL SELECT 'texts', bool_and(text IS NOT NULL), CASE WHEN bool_and(text IS NOT NULL) THEN 'ok' ELSE 'FAIL' END, 'every document has a text' FROM documents
UNION ALL SELECT 'sizes', bool_and(n_chars = length(text)), CASE WHEN bool_and(n_chars = length(text)) THEN 'ok' ELSE 'warn' END, 'sizes are those of the texts' FROM documents""",
    "redaction_boxes": f"SELECT doc_id, page_index, block_id, round(x0 - p, 6) AS x0, round(y0 - p, 6) AS y0, round(x1 + p, 6) AS x1, round(y1 + p, 6) AS y1 FROM (SELECT *, CASE WHEN doc_id % 2 = 1 THEN 2.0 ELSE 0.3 END::DOUBLE AS p FROM ({layout_queries.ORACLES['block_style']}))",
}
