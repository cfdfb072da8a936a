"""Text to ordered sentence pieces and back, as column expressions.

A text becomes ``array<struct<text, translatable>>`` inside its own row: no shuffle, no UDF.
Sentence ends are one regular expression whose look-behinds carry the abbreviation rules, so
the JVM finds all spans of a paragraph in one pass. Look-behinds are bounded; the rare
paragraph whose dots and dotted letters run on beyond them is folded over its spans instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest sentence handed to a model, in characters.
LONGEST = 900

#: Words that end in a full stop without ending a sentence, lower-case, no dot.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "st", "jr", "sr", "vs", "etc", "al", "fig", "figs", "no", "nos", "vol", "vols", "pp", "ed", "eds", "approx", "dept", "est",
    "inc", "ltd", "co", "corp", "univ", "ave", "blvd", "rd", "apt", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sept", "sep", "oct", "nov", "dec", "mon",
    "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun", "herr", "frau", "med", "dipl", "ing", "bzw", "ggf", "evtl", "inkl", "exkl", "usw",
    "sog", "vgl", "ebd", "abb", "tab", "nr", "abs", "art", "kap", "str", "hrsg", "jh", "jhd", "bspw",
)

SPACE = r"[\s\x1c-\x1f]"
_CLOSE = "[\"'”’)\\]»]*"
_DANDA_CLOSE = "[\"'”’)\\]]*"
_OPEN = "(?:^|[\\s\\x1c-\\x1f(\\[\"'])"
_NEXT = f"(?={SPACE}*\\z|{SPACE}+[\"'“‘(\\[«\\u0900-\\u097F\\p{{Nd}}A-ZÀ-Þ])"
_ENDS = f"(?={SPACE}|\\z)"
_WORDS = "|".join(sorted(ABBREVIATIONS))
#: Leading dots and dotted letters that the look-behinds see.
_DOTS, _LETTERS = 8, 16
#: A full stop counts after a digit; otherwise not after an initial, an abbreviation or letters set apart by dots.
_DOT = (
    "(?:(?<=\\p{Nd})|"
    f"(?<!\\p{{Nd}})(?<!{_OPEN}[A-ZÀ-Þ])(?<!{_OPEN}\\.{{0,{_DOTS}}}(?i:{_WORDS}))(?<!{_OPEN}\\.{{0,{_DOTS}}}(?:[\\p{{L}}\\p{{N}}_]\\.){{1,{_LETTERS}}}[\\p{{L}}\\p{{N}}_]))"
)
#: Paragraphs that the look-behinds cannot judge.
_BEYOND = f"\\.(?:\\.{{{_DOTS}}}|(?<=[\\p{{L}}\\p{{N}}_]\\.)(?:[\\p{{L}}\\p{{N}}_]\\.){{{_LETTERS}}})"
BOUNDARY = f"(?<![.!?…])(?:{_DOT}\\.[.!?…]*{_CLOSE}{_NEXT}|[!?…][.!?…]*{_CLOSE}{_ENDS})|(?<![।॥])[।॥]+{_DANDA_CLOSE}"
SENTENCE = f"(?sU).*?(?=[.!?…।॥])(?:{BOUNDARY})|.+"
PARAGRAPH = r"[\r\n]+|[^\r\n]+"
PIECES = "array<struct<text:string,translatable:boolean>>"


def piece(text: Column, translatable: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(translatable).alias("translatable"))


def paragraphs(text: Column) -> Column:
    """Alternating runs of line breaks and of other characters."""
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def sentences(paragraph: Column) -> Column:
    """Contiguous spans that cover a paragraph; each ends at a boundary or at the paragraph's end."""
    return F.when(paragraph.rlike(_BEYOND), folded_sentences(paragraph)).otherwise(F.regexp_extract_all(paragraph, F.lit(SENTENCE), F.lit(0)))


def folded_sentences(paragraph: Column) -> Column:
    """``sentences`` by a fold over the paragraph's spans up to each run of terminators, without limits."""
    run = f"[.!?…]+{_CLOSE}|[।॥]+{_DANDA_CLOSE}"
    separator = "[\\s\\x1c-\\x1f(\\[\"']"
    spans = F.regexp_extract_all(paragraph, F.lit(f"(?sU)[^.!?…।॥]*+(?:{run})|[^.!?…।॥]++"), F.lit(0))
    steps = F.transform(spans, lambda t, i: F.struct(t.alias("span"), F.get(spans, i + 1).alias("next")))

    def last_word(before: Column) -> Column:
        return F.element_at(F.split(before, f"(?U){separator}", -1), -1)

    def step(s: Column, x: Column) -> Column:
        end = F.regexp_extract(x["span"], f"(?sU)^[^.!?…।॥]*+({run})\\z", 1)
        word = last_word(F.concat(s["word"], F.substring(x["span"], F.lit(1), F.length(x["span"]) - F.length(end))))
        bare = F.regexp_replace(F.lower(word), "^\\.+|\\.+\\z", "")
        after = F.coalesce(x["next"], F.lit(""))
        fresh = after.rlike(f"(?U)^{SPACE}*+(?:\\z|[\"'“‘(\\[«\u0900-\u097F\\p{{Nd}}A-ZÀ-Þ])")
        dotted = word.rlike("^[A-ZÀ-Þ]\\z") | bare.isin(*ABBREVIATIONS) | bare.rlike("^(?:[\\p{L}\\p{N}_]\\.)++[\\p{L}\\p{N}_]\\z")
        ends = (
            F.when(end == "", False).when(end.rlike("^[।॥]"), True).when((after != "") & ~after.rlike(f"(?U)^{SPACE}"), False).when(~end.startswith("."), True)
            .when(word.rlike("\\p{Nd}\\z"), fresh).when(dotted, False).otherwise(fresh)
        )
        now = F.concat(s["open"], x["span"])
        return F.struct(F.when(ends, F.concat(s["done"], F.array(now))).otherwise(s["done"]).alias("done"), F.when(ends, F.lit("")).otherwise(now).alias("open"), last_word(F.concat(word, end)).alias("word"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit("").alias("word"))
    return F.aggregate(steps, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def _append(chunks: Column, text: Column, translatable: bool = True) -> Column:
    return F.when(text == "", chunks).otherwise(F.concat(chunks, F.array(piece(text, translatable))))


def _word_chunks(state: Column, clause: Column, limit: int) -> Column:
    """Greedy packing of a clause's words; words over the limit are cut hard; seam spaces stay as verbatim pieces."""

    def step(s: Column, word: Column) -> Column:
        full = (s["current"] != "") & (F.length(s["current"]) + F.length(word) + 1 > limit)
        chunks = F.when(full, _append(_append(s["chunks"], s["current"]), F.lit(" "), False)).otherwise(s["chunks"])
        current = F.when(full, F.lit("")).otherwise(s["current"])
        starts = s["first"] | full
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(word) - 1) / limit).cast("int"), F.lit(0))), lambda i: piece(F.substring(word, i * limit + 1, F.lit(limit)), True))
        # The space before an over-long word belongs to no chunk either.
        held = F.when((current == "") & ~starts, _append(chunks, F.lit(" "), False)).otherwise(F.when(current != "", _append(_append(chunks, current), F.lit(" "), False)).otherwise(chunks))
        long = F.struct(F.concat(held, cuts).alias("chunks"), F.lit("").alias("current"), F.lit(False).alias("first"))
        plain = F.struct(
            F.when((current == "") & ~starts, _append(chunks, F.lit(" "), False)).otherwise(chunks).alias("chunks"),
            F.when(current == "", word).otherwise(F.concat(current, F.lit(" "), word)).alias("current"),
            F.lit(False).alias("first"),
        )
        return F.when(F.length(word) > limit, long).otherwise(plain)

    start = F.struct(state.alias("chunks"), F.lit("").alias("current"), F.lit(True).alias("first"))
    return F.aggregate(F.split(clause, " ", -1), start, step, lambda s: _append(s["chunks"], s["current"]))


def split_long(sentence: Column, limit: int = LONGEST) -> Column:
    """Pieces of at most ``limit`` characters: cut after ``;`` ``,`` or danda, else at words, else anywhere."""

    def step(s: Column, clause: Column) -> Column:
        full = (s["current"] != "") & (F.length(s["current"]) + F.length(clause) > limit)
        chunks = F.when(full, _append(s["chunks"], s["current"])).otherwise(s["chunks"])
        current = F.when(full, F.lit("")).otherwise(s["current"])
        long = F.struct(_word_chunks(_append(chunks, current), clause, limit).alias("chunks"), F.lit("").alias("current"))
        return F.when(F.length(clause) > limit, long).otherwise(F.struct(chunks.alias("chunks"), F.concat(current, clause).alias("current")))

    clauses = F.regexp_extract_all(sentence, F.lit("[^;,।]*[;,।]|[^;,।]+"), F.lit(0))
    start = F.struct(F.array().cast(PIECES).alias("chunks"), F.lit("").alias("current"))
    folded = F.aggregate(clauses, start, step, lambda s: _append(s["chunks"], s["current"]))
    return F.when(F.length(sentence) <= limit, F.array(piece(sentence, True))).otherwise(folded)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _span_pieces(span: Column, limit: int) -> Column:
    def around(e: Column) -> Column:
        return _once(F.substring(span, F.length(e["lead"]) + 1, F.length(span) - F.length(e["lead"]) - F.length(e["tail"])), lambda core: whole(e, core))

    def whole(e: Column, core: Column) -> Column:
        parts = F.when(core == "", F.array().cast(PIECES)).otherwise(split_long(core, limit))
        return F.filter(F.concat(F.array(piece(e["lead"], False)), parts, F.array(piece(e["tail"], False))), lambda p: p["text"] != "")

    # Most spans end without white space, which their last character tells.
    bare = ~F.substring(span, -1, 1).rlike(f"(?sU){SPACE}")
    tail = lambda lead: F.when(bare | (F.length(lead) == F.length(span)), F.lit("")).otherwise(F.regexp_extract(span, f"(?sU)({SPACE}*)\\z", 1))
    return _once(_once(F.regexp_extract(span, f"(?sU)^({SPACE}*)", 1), lambda lead: F.struct(lead.alias("lead"), tail(lead).alias("tail"))), around)


def segment(text: Column, limit: int = LONGEST) -> Column:
    """Ordered pieces of a text; joined again they give the text. Null and empty texts have none."""

    def of(paragraph: Column) -> Column:
        return F.when(paragraph.rlike(r"^[\r\n]"), F.array(piece(paragraph, False))).otherwise(F.flatten(F.transform(sentences(paragraph), lambda s: _span_pieces(s, limit))))

    return F.flatten(F.transform(paragraphs(F.coalesce(text, F.lit(""))), of))


def reassemble(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


