"""Languages, models, routes and fonts as small dimension tables.

Dimensions are fixed-size literals or listings; joins against them broadcast on size. Routes
come from a recursive query over the model graph.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values: (code, native name, English name, script, OCR code), in menu order.
LANGUAGES = (("en", "English", "English", "latin", "eng"), ("de", "Deutsch", "German", "latin", "deu"), ("hi", "हिन्दी", "Hindi", "devanagari", "hin"))

#: Fixed values: (directory, source, target), in catalog order.
MODELS = (("opus-mt-en-de", "en", "de"), ("opus-mt-de-en", "de", "en"), ("opus-mt-en-hi", "en", "hi"), ("opus-mt-hi-en", "hi", "en"))

#: Files that make a model directory complete.
MODEL_FILES = ("model.bin", "source.spm", "target.spm")

#: Font files per script and weight, most preferred first.
FONTS = {
    ("latin", "regular"): ("segoeui.ttf", "calibri.ttf", "arial.ttf", "tahoma.ttf", "NotoSans-Regular.ttf", "DejaVuSans.ttf"),
    ("latin", "bold"): ("segoeuib.ttf", "calibrib.ttf", "arialbd.ttf", "tahomabd.ttf", "NotoSans-Bold.ttf", "DejaVuSans-Bold.ttf"),
    ("devanagari", "regular"): ("Nirmala.ttf", "mangal.ttf", "NotoSansDevanagari-Regular.ttf", "Lohit-Devanagari.ttf", "Samyak-Devanagari.ttf"),
    ("devanagari", "bold"): ("NirmalaB.ttf", "mangalb.ttf", "NotoSansDevanagari-Bold.ttf", "Lohit-Devanagari-Bold.ttf"),
}


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table, as a local relation that the optimiser can fold."""
    fields = T._parse_datatype_string(schema)
    table = pa.Table.from_pylist([dict(zip(fields.names, row)) for row in rows], schema=to_arrow_schema(fields))
    return spark.createDataFrame(table)


def languages(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(LANGUAGES)]
    return values(spark, rows, "menu_order int, code string, native_name string, english_name string, script string, ocr_code string")


def models(spark: SparkSession) -> DataFrame:
    return values(spark, [(i, *row) for i, row in enumerate(MODELS)], "ord int, directory string, source string, target string")


def normal_code(code: Column) -> Column:
    return F.lower(F.regexp_replace(code, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def named(codes: DataFrame, languages: DataFrame) -> DataFrame:
    """``codes(code)`` with the language that its trimmed, lower-cased code names, or nulls."""
    return codes.withColumn("_key", normal_code(F.col("code"))).join(F.broadcast(languages.withColumnRenamed("code", "_key")), "_key", "left").drop("_key")


def first_other_than(code: Column, languages: DataFrame, of: DataFrame) -> DataFrame:
    """``of`` with ``other``, the first language in menu order whose code differs from ``code``."""
    menu = languages.agg(F.array_sort(F.collect_list(F.struct("menu_order", "code"))).alias("_menu"))
    found = F.get(F.filter("_menu", lambda m: m["code"] != code), F.lit(0))["code"]
    return of.crossJoin(F.broadcast(menu)).withColumn("other", found).drop("_menu")


def pair_key(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit("->"), target)


def model_for(pairs: DataFrame, models: DataFrame) -> DataFrame:
    """``pairs(source, target)`` with the first model of the catalog for exactly that pair."""
    first = models.groupBy("source", "target").agg(F.min_by("directory", "ord").alias("directory"))
    return pairs.join(F.broadcast(first), ["source", "target"], "left")


def installed(listing: DataFrame) -> DataFrame:
    """Directories of ``listing(directory, file)`` that hold every model file."""
    return listing.filter(F.col("file").isin(*MODEL_FILES)).groupBy("directory").agg(F.countDistinct("file").alias("n")).filter(F.col("n") == len(MODEL_FILES)).select("directory")


def missing(models: DataFrame, listing: DataFrame) -> DataFrame:
    return models.join(installed(listing), "directory", "left_anti")


def shortest_routes(models: list[tuple[int, str, str, str]]) -> dict[tuple[str, str], list[str]]:
    """Directories of the shortest path between any two languages of (ord, directory, source, target).

    One breadth-first pass per language that keeps one path per pair. Among shortest paths the
    one with the smallest catalog order, edge by edge, is taken.
    """
    edges = sorted(models)
    found: dict[tuple[str, str], list[str]] = {}
    for start in {m[2] for m in edges} | {m[3] for m in edges}:
        # (orders, directories) of the best way to each language of the last layer.
        layer: dict[str, tuple[list[int], list[str]]] = {start: ([], [])}
        while layer:
            found |= {(start, at): way[1] for at, way in layer.items()}
            after: dict[str, tuple[list[int], list[str]]] = {}
            for order, directory, source, target in edges:
                if source in layer and (start, target) not in found:
                    way = ([*layer[source][0], order], [*layer[source][1], directory])
                    after[target] = min(after.get(target, way), way)
            layer = after
    return found


def routes(models: DataFrame) -> DataFrame:
    """(source, target, route): directories of the shortest path between any two languages of the graph.

    The route from a language to itself is empty; pairs without a path are absent. The catalog
    is a list of installed models, so it is walked on the driver.
    """
    rows = [tuple(r) for r in models.select("ord", "directory", "source", "target").collect()]
    return values(models.sparkSession, [(*pair, way) for pair, way in sorted(shortest_routes(rows).items())], "source string, target string, route array<string>")


def route_on_driver(models: DataFrame, source: str, target: str) -> list[str]:
    """One route, at most as long as the catalog; raises LookupError without one."""
    found = shortest_routes([tuple(r) for r in models.select("ord", "directory", "source", "target").collect()])
    if (source, target) not in found:
        raise LookupError(f"no route from {source} to {target}")
    return found[source, target]


def route_matrix(languages: DataFrame, models: DataFrame) -> DataFrame:
    """(source, target, has_route, pivots, hops) of all ordered pairs of different languages."""
    a, b = languages.select(F.col("code").alias("source")), languages.select(F.col("code").alias("target"))
    pairs = a.join(b, a["source"] != b["target"]).join(routes(models), ["source", "target"], "left")
    hops = F.size("route")
    return pairs.select("source", "target", F.coalesce(hops > 0, F.lit(False)).alias("has_route"), F.coalesce(hops > 1, F.lit(False)).alias("pivots"), F.when(F.col("route").isNotNull(), hops).alias("hops"))


def reachable_targets(languages: DataFrame, models: DataFrame) -> DataFrame:
    """(source, targets): what each language reaches besides itself, in menu order."""
    found = routes(models).filter("source <> target").join(F.broadcast(languages.select(F.col("code").alias("target"), "menu_order")), "target")
    return found.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("menu_order", "target"))), lambda x: x["target"]).alias("targets"))


def route_note(hops: Column) -> Column:
    return F.when(hops.isNull(), "no route").when(hops > 1, "via pivot").otherwise("")


def font_index(listing: DataFrame) -> DataFrame:
    """(key, path): one file per lower-cased name, from the most preferred directory (then smallest path)."""
    files = listing.filter(F.lower("file").rlike(r"\.(ttf|otf|ttc)$")).withColumn("key", F.lower("file")).withColumn("path", F.concat("directory", F.lit("/"), "file"))
    order = Window.partitionBy("key").orderBy("dir_rank", "path")
    return files.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("key", "path")


def font_choice(listing: DataFrame) -> DataFrame:
    """(script, regular, bold, error_code): the first present font of each preference list.

    Latin falls back to the smallest path of any font; other scripts report FONT_NOT_FOUND.
    """
    spark = listing.sparkSession
    index = font_index(listing)
    wanted = values(spark, [(s, w, i, f.lower()) for (s, w), files in FONTS.items() for i, f in enumerate(files)], "script string, weight string, rank int, key string")
    best = wanted.join(index, "key", "left").groupBy("script").agg(F.expr("min_by(path, rank) FILTER (WHERE weight = 'regular' AND path IS NOT NULL)").alias("regular"), F.expr("min_by(path, rank) FILTER (WHERE weight = 'bold' AND path IS NOT NULL)").alias("bold"))
    out = best.crossJoin(F.broadcast(index.agg(F.min("path").alias("any"))))
    regular = F.coalesce("regular", F.when(F.col("script") == "latin", F.col("any")))
    return out.select("script", regular.alias("regular"), F.coalesce("bold", regular).alias("bold_or_regular"), F.when(regular.isNull(), "FONT_NOT_FOUND").alias("error_code"))


def font_alias(path: Column, prefix: str = "F") -> Column:
    """A short name of letters and digits for an embedded font file."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    clean = F.regexp_replace(stem, r"(?U)[^\p{L}\p{N}]", "")
    return F.when(clean == "", F.lit(f"{prefix}Font")).otherwise(F.concat(F.lit(prefix), F.substring(clean, 1, 24)))


def supports(code: Column, available: Column) -> Column:
    return F.coalesce(F.array_contains(available, code), F.lit(False))


def ocr_languages(lines: DataFrame) -> DataFrame:
    """Language names of a listing ``lines(pos, line)``: without its header, blanks and names with a space."""
    name = F.trim("line")
    return lines.filter("pos >= 1").select(name.alias("code")).filter((F.col("code") != "") & ~F.col("code").contains(" "))
