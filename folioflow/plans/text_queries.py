"""Segmentation and translation queries over ``documents`` with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.segment import paragraphs, reassemble, segment
from folioflow.operators import catalog, translate
from folioflow.plans import oracle
from folioflow.sources import spread, table

DOCS = "SELECT doc_id AS id, text FROM documents"
_PIECES = "WITH RECURSIVE " + oracle.pieces(DOCS)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "text"))


def paragraph_pieces(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("pos", "text"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "text", F.col("text").rlike(r"^[\r\n]").alias("is_break"))


def sentence_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return translate.exploded(_docs(spark, sf)).filter("pos is not null").select("doc_id", F.col("pos").cast("long").alias("pos"), "text", "translatable")


def reassembly_check(spark: SparkSession, sf: str) -> DataFrame:
    pieces = _docs(spark, sf).select("doc_id", "text", segment(F.col("text")).alias("p"))
    return pieces.select("doc_id", F.size("p").cast("long").alias("n_pieces"), (reassemble(F.col("p")) == F.coalesce("text", F.lit(""))).alias("lossless"))


def sentence_stats_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", "lang", F.posexplode(segment(F.col("text"))).alias("pos", "p")).filter("p.translatable")
    # Distinct sentences are counted from one row per language and sentence, so one shuffle on that pair serves all columns.
    per = docs.groupBy("lang", F.col("p.text").alias("s")).agg(F.count("*").alias("uses"), F.sum(F.length("p.text")).alias("chars"))
    return per.groupBy("lang").agg(F.sum("uses").alias("sentences"), F.count("*").alias("distinct_sentences"), F.sum("chars").alias("characters"))


def distinct_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return translate.distinct_sentences(translate.exploded(_docs(spark, sf)))


def translate_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", "text")
    return translate.translate_hop(docs, translate.bracket_model).select("doc_id", F.col("text").alias("translated"), "failed")


def translate_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Every document to Hindi by its own route: none, one model, or two."""
    docs = _docs(spark, sf).select("doc_id", F.col("lang").alias("source"), "text")
    routes = catalog.routes(catalog.models(spark))
    done = translate.translate_routed(docs, routes, "hi", translate.bracket_model, longest=2)
    return done.select("doc_id", "hops", F.col("text").alias("translated"), "error_code")


def document_report(spark: SparkSession, sf: str, target: str = "hi") -> DataFrame:
    """Per language: documents, hops, sentences, distinct sentences and the share of repeats."""
    docs = _docs(spark, sf).select("doc_id", "lang", "text")
    hops = catalog.routes(catalog.models(spark)).filter(F.col("target") == target).select(F.col("source").alias("lang"), F.size("route").cast("long").alias("hops"))
    sizes = docs.groupBy("lang").agg(F.count("*").alias("documents"))
    stats = sentence_stats_by_lang(spark, sf).select("lang", "sentences", "distinct_sentences")
    out = sizes.join(stats, "lang", "left").join(F.broadcast(hops), "lang", "left")
    return out.select(
        "lang", "documents", "hops", F.when(F.col("hops").isNull(), "NO_ROUTE").alias("error_code"), F.coalesce("sentences", F.lit(0)).alias("sentences"), F.coalesce("distinct_sentences", F.lit(0)).alias("distinct_sentences"),
        F.round(1 - F.col("distinct_sentences") / F.col("sentences"), 6).alias("repeat_share"),
    )


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    """A warm cache: the sentences of ``benchmark``, used last by their largest item."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    uses = translate.exploded(items).filter("translatable").groupBy(F.col("text").alias("sentence")).agg(F.max("doc_id").alias("last_used"))
    return translate.bracket_model(uses)


def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    wanted = translate.distinct_sentences(translate.exploded(_docs(spark, sf)))
    return translate.cache_probe(wanted, _cache(spark, sf))[0]


def cache_pending(spark: SparkSession, sf: str) -> DataFrame:
    wanted = translate.distinct_sentences(translate.exploded(_docs(spark, sf)))
    return translate.cache_probe(wanted, _cache(spark, sf))[1]


def cache_retention(spark: SparkSession, sf: str) -> DataFrame:
    """An evicting cache of 50 entries after all of ``benchmark``: the limit is the operator's."""
    return translate.retained(_cache(spark, sf), 50).select("sentence", "last_used")


def cache_write_back(spark: SparkSession, sf: str) -> DataFrame:
    """The cache of ``benchmark`` after a run over all documents, with room for 400 entries: the limit is the operator's."""
    cache, direction = _cache(spark, sf).withColumn("pair", F.lit("en->de")), F.lit("en->de")
    wanted = translate.distinct_sentences(translate.exploded(_docs(spark, sf).withColumn("pair", direction)))
    used = translate.translations(wanted, translate.bracket_model, cache)
    return translate.written_back(cache, used, 1000, 400).select("pair", "sentence", "translation", "last_used")


def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    return translate.batch_plan(translate.distinct_sentences(translate.exploded(_docs(spark, sf))).select("sentence"))


def length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return translate.length_buckets(batch_plan(spark, sf))


def long_sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces under a limit of 60 characters: most sentences are split."""
    rows = _docs(spark, sf).select("doc_id", F.posexplode(segment(F.col("text"), 60)).alias("pos", "p"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "p.text", "p.translatable")


_DISTINCT = _PIECES + ",\nwanted AS (SELECT text AS sentence, count(*) AS uses FROM piece WHERE translatable GROUP BY text)"
_WARM = _DISTINCT + ",\n" + oracle.pieces("SELECT item_id AS id, text FROM benchmark", suffix="2") + ",\ncache AS (SELECT text AS sentence, '[' || text || ']' AS translation, max(id) AS last_used FROM piece2 WHERE translatable GROUP BY text)"
_BATCHES = _DISTINCT + ",\nranked AS (SELECT sentence, length(sentence) AS length, row_number() OVER (ORDER BY length(sentence) DESC, sentence) - 1 AS rnk FROM wanted), batches AS (SELECT sentence, length, rnk // 24 AS batch_id, (rnk % 24)::INT AS slot FROM ranked)"


#: Hops of the shortest way from each language to Hindi, found in the catalog of models.
_HOPS = """model(s, t) AS (VALUES ('en', 'de'), ('de', 'en'), ('en', 'hi'), ('hi', 'en')),
walk(s, t, n) AS (SELECT DISTINCT s, s, 0 FROM model UNION SELECT walk.s, model.t, n + 1 FROM walk JOIN model ON model.s = walk.t WHERE n < 4),
hops AS (SELECT s AS lang, min(n)::BIGINT AS hops FROM walk WHERE t = 'hi' GROUP BY s)"""


def _hop(pieces: str) -> str:
    return f"SELECT id, string_agg(CASE WHEN translatable THEN '[' || text || ']' ELSE text END, '' ORDER BY pos) AS text FROM {pieces} GROUP BY id"


QUERIES = {
    f.__name__: f
    for f in (
        paragraph_pieces, sentence_pieces, reassembly_check, sentence_stats_by_lang, distinct_sentences, translate_one_hop, translate_pivot, document_report, cache_hits, cache_pending, cache_retention, cache_write_back,
        batch_plan, length_buckets, long_sentence_split,
    )
}
ORACLES = {
    "paragraph_pieces": f"WITH source AS ({DOCS}),{oracle.PAR} SELECT id AS doc_id, par_no AS pos, p AS text, regexp_matches(p, '^[\\r\\n]') AS is_break FROM par",
    "sentence_pieces": _PIECES + " SELECT id AS doc_id, pos, text, translatable FROM piece",
    "reassembly_check": _PIECES + " SELECT d.doc_id, coalesce(n, 0) AS n_pieces, coalesce(t, '') = coalesce(d.text, '') AS lossless FROM documents d LEFT JOIN (SELECT id, count(*) AS n, string_agg(text, '' ORDER BY pos) AS t FROM piece GROUP BY id) ON id = d.doc_id",
    "sentence_stats_by_lang": _PIECES + " SELECT lang, count(*) AS sentences, count(DISTINCT piece.text) AS distinct_sentences, sum(length(piece.text))::BIGINT AS characters FROM piece JOIN documents ON id = doc_id WHERE translatable GROUP BY lang",
    "distinct_sentences": _DISTINCT + " SELECT sentence, uses FROM wanted",
    "translate_one_hop": _PIECES + f" SELECT d.doc_id, coalesce(h.text, '') AS translated, 0::BIGINT AS failed FROM documents d LEFT JOIN ({_hop('piece')}) h ON h.id = d.doc_id",
    "translate_pivot": "WITH RECURSIVE " + _HOPS + ",\n" + oracle.pieces("SELECT doc_id AS id, text FROM documents JOIN hops USING (lang)") + ",\n" + oracle.pieces(f"SELECT h.id, h.text FROM ({_hop('piece')}) h JOIN documents ON doc_id = h.id JOIN hops USING (lang) WHERE hops = 2", suffix="2")
    + f""" SELECT d.doc_id, hops, CASE hops WHEN 0 THEN d.text WHEN 1 THEN coalesce(a.text, '') WHEN 2 THEN coalesce(b.text, '') END AS translated, CASE WHEN hops IS NULL THEN 'NO_ROUTE' END AS error_code
FROM documents d LEFT JOIN hops USING (lang) LEFT JOIN ({_hop('piece')}) a ON a.id = d.doc_id LEFT JOIN ({_hop('piece2')}) b ON b.id = d.doc_id""",
    "document_report": _PIECES + f", {_HOPS}" + """, st AS (SELECT lang, count(*) AS s, count(DISTINCT piece.text) AS u FROM piece JOIN documents ON id = doc_id WHERE translatable GROUP BY lang)
SELECT d.lang, count(*) AS documents, any_value(h.hops) AS hops, CASE WHEN any_value(h.hops) IS NULL THEN 'NO_ROUTE' END AS error_code, coalesce(any_value(s), 0) AS sentences, coalesce(any_value(u), 0) AS distinct_sentences,
  round(1 - any_value(u) / any_value(s), 6) AS repeat_share
FROM documents d LEFT JOIN st ON st.lang = d.lang LEFT JOIN hops h ON h.lang = d.lang GROUP BY d.lang""",
    "cache_hits": _WARM + " SELECT sentence, translation FROM wanted JOIN cache USING (sentence)",
    "cache_pending": _WARM + " SELECT sentence FROM wanted ANTI JOIN cache USING (sentence)",
    "cache_retention": "WITH RECURSIVE " + oracle.pieces("SELECT item_id AS id, text FROM benchmark") + " SELECT text AS sentence, max(id) AS last_used FROM piece WHERE translatable GROUP BY text ORDER BY last_used DESC, sentence DESC LIMIT 50",
    "cache_write_back": _WARM + """ SELECT 'en->de' AS pair, sentence, arg_max(translation, last_used) AS translation, max(last_used) AS last_used
FROM (SELECT sentence, translation, last_used FROM cache UNION ALL SELECT sentence, '[' || sentence || ']', 1000 FROM wanted) GROUP BY sentence ORDER BY last_used DESC, sentence DESC LIMIT 400""",
    "batch_plan": _BATCHES + " SELECT sentence, length, batch_id, slot FROM batches",
    "length_buckets": _BATCHES + r""", counted AS (
  SELECT batch_id, list_sort(list(len(regexp_extract_all(sentence, '[^\s\x1c-\x1f]+')))) AS t FROM batches GROUP BY batch_id),
grown AS (
  SELECT batch_id, 1 AS i, 0 AS bucket, t[1] AS low, t[1] AS n, t FROM counted
  UNION ALL SELECT batch_id, i + 1, CASE WHEN t[i + 1] <= 2 * low THEN bucket ELSE bucket + 1 END, CASE WHEN t[i + 1] <= 2 * low THEN low ELSE t[i + 1] END, t[i + 1], t FROM grown WHERE i < len(t))
SELECT batch_id, bucket, count(*)::INT AS size, min(n) AS shortest, max(n) AS longest, greatest(16, 3 * max(n) + 8) AS cap FROM grown GROUP BY batch_id, bucket""",
    "long_sentence_split": "WITH RECURSIVE " + oracle.pieces(DOCS, 60) + " SELECT id AS doc_id, pos, text, translatable FROM piece",
}
