import pytest
from pyspark.sql import functions as F

from folioflow.operators import catalog, translate


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def counted(log):
    def model(sentences):
        log.append(sentences.count())
        return translate.bracket_model(sentences)

    return model


def test_repeats_reach_the_model_once(spark):
    log = []
    out = translate.translate_hop(texts(spark, ["Keep dry."] * 20), counted(log))
    assert [r.text for r in out.collect()] == ["[Keep dry.]"] * 20
    assert log == [1]


def test_blanks_and_order(spark):
    out = translate.translate_hop(texts(spark, ["oak", "", "elm", "   ", "ash", None]), translate.bracket_model)
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["[oak]", "", "[elm]", "   ", "[ash]", ""]


def test_cache_hits_skip_the_model(spark):
    log = []
    cache = spark.createDataFrame([("One.", "", 1)], "sentence string, translation string, last_used long")
    out = translate.translate_hop(texts(spark, ["One. Two."]), counted(log), cache)
    assert out.first().text == " [Two.]"
    assert log == [1]


def test_batches_of_24(spark):
    words = spark.createDataFrame([("s" * (1 + i % 40) + f"{i:02d}",) for i in range(40)], "sentence string")
    sizes = dict(translate.batch_plan(words).groupBy("batch_id").count().collect())
    assert sizes == {0: 24, 1: 16}


def test_buckets_and_caps(spark):
    words = spark.createDataFrame([("w",), (" ".join(["w"] * 60),)], "sentence string")
    caps = [r.cap for r in translate.length_buckets(translate.batch_plan(words)).orderBy("bucket").collect()]
    assert len(caps) == 2
    assert caps[0] < 32
    assert caps[1] > 100


def test_direction_is_part_of_the_cache(spark):
    log = []
    cache = spark.createDataFrame([("en->de", "One.", "Eins.", 1)], "pair string, sentence string, translation string, last_used long")
    rows = spark.createDataFrame([(1, "en->de", "One. Two."), (2, "en->hi", "One.")], "doc_id long, pair string, text string")
    out = {r.doc_id: r.text for r in translate.translate_hop(rows, counted(log), cache).collect()}
    assert out == {1: "Eins. [Two.]", 2: "[One.]"}
    assert log == [2]


def test_write_back_refreshes_and_evicts(spark):
    schema = "pair string, sentence string, translation string, last_used long"
    cache = spark.createDataFrame([("p", "a", "A", 1), ("p", "b", "B", 2), ("p", "c", "C", 3), ("q", "a", "X", 3)], schema)
    used = spark.createDataFrame([("p", "a", "A"), ("p", "d", "D"), ("p", "e", None)], "pair string, sentence string, translation string")
    after = translate.written_back(cache, used, 4, 3)
    assert {tuple(r) for r in after.select("pair", "sentence", "translation", "last_used").collect()} == {("p", "a", "A", 4), ("p", "d", "D", 4), ("p", "c", "C", 3)}
    hits, pending = translate.cache_probe(spark.createDataFrame([("p", "a"), ("q", "d")], "pair string, sentence string"), after)
    assert [tuple(r) for r in hits.collect()] == [("p", "a", "A")]
    assert [tuple(r) for r in pending.collect()] == [("q", "d")]


def test_failed_sentences_are_counted_not_raised(spark):
    def partly(sentences):
        return sentences.withColumn("translation", F.when(~F.col("sentence").contains("bad"), F.upper("sentence")))

    rows = spark.createDataFrame([(1, "de", "Good. A bad one. Good."), (2, "fr", "Rien."), (3, "hi", "Same."), (4, "en", "Fine.")], "doc_id long, source string, text string")
    routes = catalog.routes(catalog.models(spark))
    got = {r.doc_id: (r.hops, r.text, r.error_code) for r in translate.translate_routed(rows, routes, "hi", partly, 2).collect()}
    assert got == {1: (2, "GOOD. A bad one. GOOD.", "TRANSLATION_FAILED"), 2: (None, None, "NO_ROUTE"), 3: (0, "Same.", None), 4: (1, "FINE.", None)}


def test_white_space_pieces_meet_nowhere_in_the_join(spark):
    rows = texts(spark, ["a b. C d. \n\n E f."] * 50)
    pieces = translate.exploded(rows)
    keys = pieces.filter(~F.col("translatable")).select(F.xxhash64("doc_id", "pos").alias("k"))
    assert keys.distinct().count() == keys.count() > 100


def test_retention(spark):
    cache = spark.createDataFrame([(f"s{i}", i) for i in range(10)], "sentence string, last_used long")
    assert {r.sentence for r in translate.retained(cache, 3).collect()} == {"s7", "s8", "s9"}
    assert translate.retained(cache, 0).count() == 1


def test_routes(spark):
    models = catalog.models(spark)
    assert catalog.route_on_driver(models, "de", "hi") == ["opus-mt-de-en", "opus-mt-en-hi"]
    assert catalog.route_on_driver(models, "en", "en") == []
    with pytest.raises(LookupError):
        catalog.route_on_driver(models.filter("ord = 0"), "en", "hi")
    graph = [(0, "ab", "a", "b"), (1, "bd", "b", "d"), (2, "ac", "a", "c"), (3, "cd", "c", "d"), (4, "da", "d", "a")]
    ways = catalog.shortest_routes(graph)
    assert ways["a", "d"] == ["ab", "bd"]
    assert ways["c", "b"] == ["cd", "da", "ab"]
    dense = [(i, f"{a}{b}", a, b) for i, (a, b) in enumerate((a, b) for a in map(str, range(40)) for b in map(str, range(40)) if a != b)]
    assert all(len(w) == (a != b) for (a, b), w in catalog.shortest_routes(dense).items())
    one = models.filter("ord = 0")
    reach = {r.source: r.targets for r in catalog.reachable_targets(catalog.languages(spark), one).collect()}
    assert reach == {"en": ["de"]}


def test_languages(spark):
    codes = spark.createDataFrame([(" EN\t",), ("xx",), (None,)], "code string")
    assert [r.english_name for r in catalog.named(codes, catalog.languages(spark)).collect()] == ["English", None, None]


def test_font_alias(spark):
    df = spark.createDataFrame([("/a/DejaVu Sans-Bold.ttf",), ("/a/--.ttf",)], "p string")
    assert [r[0] for r in df.select(catalog.font_alias(F.col("p"))).collect()] == ["FDejaVuSansBold", "FFont"]
