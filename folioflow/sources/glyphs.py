"""Positioned glyphs and OCR words laid out from plain texts.

No PDF decoder is assumed. A text is set on a fixed grid: 50 rows a page, 14 points apart,
6 points a character, a column gap of 60 points before the 61st character, the first line
as a bold heading of 22 points. All arithmetic is on integers, so engines agree exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose glyphs are laid out at a time; one page at least.
CHUNK = 1 << 19
ROWS, ADVANCE, LEADING, LEFT, TOP, HEIGHT, COLUMN, GAP = 50, 6, 14, 72, 100, 10, 60, 60


def glyphs(docs: DataFrame) -> DataFrame:
    """(doc_id, page_index, pos, text, x0, y0, x1, y1, size, font, color, flags) of every character but line breaks."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("r", "line"))
    chars = lines.select("doc_id", "r", F.posexplode(F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0))).alias("i", "text"))
    r, i = F.col("r"), F.col("i")
    x0 = LEFT + ADVANCE * i + F.when(i >= COLUMN, GAP).otherwise(0)
    y0 = TOP + LEADING * F.pmod(r, F.lit(ROWS))
    return chars.select(
        "doc_id", F.floor(r / ROWS).cast("int").alias("page_index"), (r.cast("long") * 1_000_000 + i).alias("pos"), "text", x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        (x0 + ADVANCE).cast("double").alias("x1"), (y0 + HEIGHT).cast("double").alias("y1"), F.when(r == 0, 22.0).otherwise(10.0).alias("size"), F.lit("Serif").alias("font"),
        F.when(F.pmod(r, F.lit(5)) == 0, 255).otherwise(0).alias("color"), (F.when(r == 0, 16).otherwise(0) + F.when(F.pmod(r, F.lit(11)) == 3, 2).otherwise(0)).alias("flags"),
    )


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_index, glyphs): ``glyphs`` as a source of whole pages, each page's characters in one array; nothing is moved."""
    split = docs.select("doc_id", F.split("text", "\n", -1).alias("rows"))
    paged = split.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / ROWS).cast("int"))).alias("page_index"), "rows")
    paged = paged.select("doc_id", "page_index", F.slice("rows", F.col("page_index") * ROWS + 1, F.lit(ROWS)).alias("rows"))

    def glyph(text: Column, r: Column, i: Column) -> Column:
        x0, y0, row = LEFT + ADVANCE * i + F.when(i >= COLUMN, GAP).otherwise(0), TOP + LEADING * r, F.col("page_index") * ROWS + r
        return F.struct(
            (row.cast("long") * 1_000_000 + i).alias("pos"), text.alias("text"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + ADVANCE).cast("double").alias("x1"), (y0 + HEIGHT).cast("double").alias("y1"),
            F.when(row == 0, 22.0).otherwise(10.0).alias("size"), F.lit("Serif").alias("font"), F.when(F.pmod(row, F.lit(5)) == 0, 255).otherwise(0).alias("color"),
            (F.when(row == 0, 16).otherwise(0) + F.when(F.pmod(row, F.lit(11)) == 3, 2).otherwise(0)).alias("flags"),
        )

    chars = F.flatten(F.transform("rows", lambda line, r: F.transform(F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0)), lambda c, i: glyph(c, r, i))))
    return paged.select("doc_id", "page_index", chars.alias("glyphs")).filter(F.size("glyphs") > 0)


def page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pages`` of batches (doc_id, text) inside a Python worker, so that no glyph crosses into the JVM; a reader for ``layout.page_blocks``."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string())
        n = len(texts)
        if not n or texts.buffers()[2] is None:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        # Pages begin where a text does and after every ROWS-th line break of it.
        breaks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0]
        doc = np.searchsorted(offsets, breaks, "right") - 1
        rank = np.arange(1, len(breaks) + 1) - np.searchsorted(breaks, offsets[:-1])[doc]
        turn = rank % ROWS == 0
        owner = np.concatenate((np.arange(n), doc[turn]))
        start = np.concatenate((offsets[:-1], breaks[turn] + 1))
        index = np.concatenate((np.zeros(n, np.int64), rank[turn] // ROWS))
        order = np.lexsort((index, owner))
        owner, start, index = owner[order], start[order], index[order]
        a = 0
        while a < len(start):
            b = max(int(np.searchsorted(start, start[a] + CHUNK)), a + 1)
            end = start[b] if b < len(start) else offsets[-1]
            found = _page_glyphs(data[start[a] : end], start[a:b] - start[a], index[a:b])
            if found is not None:
                held, glyphs = found
                yield pa.record_batch([batch.column("doc_id").take(pa.array(owner[a:b][held])), pa.array(index[a:b][held].astype(np.int32)), glyphs], names=["doc_id", "page_index", "glyphs"])
            a = b


def _page_glyphs(data: np.ndarray, start: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, pa.ListArray] | None:
    """Which of the pages that begin at ``start`` in the UTF-8 ``data`` have glyphs, and these."""
    keep = data != 10
    lead = keep & ((data & 0xC0) != 0x80)
    at = np.flatnonzero(lead)
    if not len(at):
        return None
    page = np.searchsorted(start, at, "right") - 1
    before = np.cumsum(~keep)
    r = before[at] - np.where(start > 0, before[np.maximum(start, 1) - 1], 0)[page]
    fresh = np.concatenate(([True], (np.diff(page) != 0) | (np.diff(r) != 0)))
    n = np.arange(len(at))
    i = n - np.maximum.accumulate(np.where(fresh, n, 0))
    row = index[page] * ROWS + r
    x0, y0 = LEFT + ADVANCE * i + np.where(i >= COLUMN, GAP, 0), TOP + LEADING * r
    kept = np.append(np.flatnonzero(lead[keep]), keep.sum()).astype(np.int32)
    text = pa.StringArray.from_buffers(len(at), pa.py_buffer(kept), pa.py_buffer(data[keep].tobytes()))
    fields = {
        "pos": row * 1_000_000 + i, "text": text, "x0": x0.astype(float), "y0": y0.astype(float), "x1": (x0 + ADVANCE).astype(float), "y1": (y0 + HEIGHT).astype(float), "size": np.where(row == 0, 22.0, 10.0),
        "font": pa.DictionaryArray.from_arrays(np.zeros(len(at), np.int8), ["Serif"]), "color": np.where(row % 5 == 0, 255, 0).astype(np.int32), "flags": (np.where(row == 0, 16, 0) + np.where(row % 11 == 3, 2, 0)).astype(np.int32),
    }
    count = np.bincount(page, minlength=len(start))
    held = np.flatnonzero(count)
    ends = np.concatenate(([0], np.cumsum(count[held]))).astype(np.int32)
    return held, pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in fields.values()], names=list(fields)))


def ocr_words(docs: DataFrame) -> DataFrame:
    """Recogniser output, every field a string: one row per space-separated word, eight words a line."""
    words = docs.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))
    line, slot = F.floor(F.col("pos") / 8), F.pmod(F.col("pos"), F.lit(8))
    fields = {
        "level": F.when(F.pmod("pos", F.lit(97)) == 0, 4).otherwise(5), "page_num": F.lit(1), "block_num": F.floor(line / 20) + 1, "par_num": F.lit(1), "line_num": line + 1, "word_num": slot + 1,
        "left": slot * 300, "top": line * 60, "width": F.length("word") * 25, "height": F.lit(50), "conf": F.pmod(F.col("doc_id") * 37 + F.col("pos") * 17, F.lit(101)),
    }
    return words.select("doc_id", F.col("pos").cast("long").alias("pos"), *(c.cast("string").alias(n) for n, c in fields.items()), F.col("word").alias("text"))
