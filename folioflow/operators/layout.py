"""Glyphs to lines to blocks.

Where a line or block ends depends on the line or block so far (a running mean, a median of
gaps), so these two decisions are folds over one page. A page is one row with its glyphs, or
its lines, in an array; Arrow batches hold many pages. Line breaks are looked for run by run
of glyphs at one height, and line texts, boxes, sizes and styles are array passes over the
whole batch. The fold over lines only numbers blocks; what a block holds is an aggregate.
"""

from __future__ import annotations

import math
import re
import statistics
from bisect import insort
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_index")

#: Ratios to the median glyph height, and to sizes and widths of lines.
SAME_LINE, WORD_SPACE, COLUMN_BREAK = 0.5, 0.28, 2.5
SAME_PARAGRAPH, EDGE_TOLERANCE, SIZE_JUMP, MINIMUM_OVERLAP = 0.85, 0.6, 1.35, 0.4
MAJORITY = 0.6
BOLD, ITALIC = 16, 2
LEAST_TEXT = 12

#: Fixed value: how a line that opens a list item begins.
LIST_MARKER = r"(?U)^([•·‣▪◦⁃∙*]|[-–—][\s\x1c-\x1f]|\(?\p{Nd}{1,2}[.)][\s\x1c-\x1f]|\(?[a-z][.)][\s\x1c-\x1f]|\(?[ivx]{1,4}[.)][\s\x1c-\x1f])"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank(text: Column) -> Column:
    return strip(text) == ""


def horizontal(direction: Column) -> Column:
    """True for text set from left to right; a missing or short direction counts as such."""
    dx, dy = F.get(direction, F.lit(0)), F.get(direction, F.lit(1))
    return F.when(direction.isNull() | (F.size(direction) < 2), True).otherwise((F.abs(dx - 1) < 0.05) & (F.abs(dy) < 0.05))


def normal_box(box: Column) -> Column:
    """struct<x0, y0, x1, y1> with corners in order; null for fewer than four or non-finite values."""
    v = [F.get(box, F.lit(i)).cast("double") for i in range(4)]
    finite = F.lit(True)
    for x in v:
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    parts = (F.least(v[0], v[2]).alias("x0"), F.least(v[1], v[3]).alias("y0"), F.greatest(v[0], v[2]).alias("x1"), F.greatest(v[1], v[3]).alias("y1"))
    return F.when(finite, F.struct(*parts))


def bold(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(BOLD) != 0) | F.lower(font).contains("bold")


def italic(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(ITALIC) != 0) | F.lower(font).contains("italic")


def rgb(color: Column) -> Column:
    """0xRRGGBB as struct<r, g, b> of doubles from 0 to 1."""
    part = lambda shift: (F.shiftright(color, shift).bitwiseAND(255) / 255.0)
    return F.struct(part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def usable_text_layer(text: Column, least: int = LEAST_TEXT) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]", "")) >= least


def box_of() -> list[Column]:
    """Aggregates of the union of boxes; zeros where there is none."""
    return [F.coalesce(f(c), F.lit(0.0)).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]


LINE = "doc_id long, page_index int, line_id int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, color int, bold boolean, italic boolean"


GLYPHS = "array<struct<pos:long,text:string,x0:double,y0:double,x1:double,y1:double,size:double,font:string,color:int,flags:int>>"


def pages(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_index, glyphs) from one row a glyph, in order of ``pos``: one shuffle. A source of whole pages gives this itself.

    Where there is a column ``direction``, only glyphs set from left to right are taken.
    """
    if "direction" in glyphs.columns:
        glyphs = glyphs.filter(horizontal(F.col("direction")))
    fields = [f.split(":")[0] for f in GLYPHS.removeprefix("array<struct<").removesuffix(">>").split(",")]
    return glyphs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(GLYPHS).alias("glyphs"))


def _medians(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Median of the values of each of ``n`` groups; nan for groups without any."""
    if n and len(value) and (np.diff(group) >= 0).all():
        # Groups of one value, as most are, need no order.
        head = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
        low, high = np.minimum.reduceat(value, head), np.maximum.reduceat(value, head)
        out = np.full(n, math.nan)
        out[group[head]] = low
        mixed = np.zeros(n, bool)
        mixed[group[head]] = ~(low == high)
        if mixed.any():
            rest = mixed[group]
            out[mixed] = _sorted_medians(group[rest], value[rest], n)[mixed]
        return out
    return _sorted_medians(group, value, n)


def _sorted_medians(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, group))
    value, count = value[order], np.bincount(group, minlength=n)
    first = np.cumsum(count) - count
    if not len(value):
        return np.full(n, math.nan)
    low = np.minimum(first + np.maximum(count - 1, 0) // 2, len(value) - 1)
    high = np.minimum(first + count // 2, len(value) - 1)
    return np.where(count > 0, (value[low] + value[high]) / 2, math.nan)


def _by_value(column: pa.Array, test) -> np.ndarray:
    """``test`` of every string, worked out once for each distinct one."""
    coded = column if pa.types.is_dictionary(column.type) else column.dictionary_encode()
    return np.array([test(t or "") for t in coded.dictionary.to_pylist()] or [False])[coded.indices.fill_null(0).to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, bool)


def _breaks(x0: np.ndarray, x1: np.ndarray, middle: np.ndarray, page: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which visible glyphs begin a line, and the right edge of the line before each glyph.

    A glyph begins a line where it leaves the running mean of the line's middles by more than
    half the page's median glyph height, or lies beyond its right edge by more than a column
    break. Glyphs of one height in a row leave the mean together or not at all. The mean takes
    them in one by one, as its rounding decides where a glyph stands just at the limit.
    """
    n = len(x0)
    new, reach = np.zeros(n, bool), np.zeros(n)
    if not n:
        return new, reach
    changes = np.flatnonzero((middle[1:] != middle[:-1]) | (page[1:] != page[:-1])) + 1
    mean, count, edge, last = 0.0, 0, -math.inf, -1
    for a, b in zip([0, *changes.tolist()], [*changes.tolist(), n]):
        at, m = page[a], float(middle[a])
        wide = COLUMN_BREAK * unit[at]
        if at != last or abs(m - mean) > SAME_LINE * unit[at]:
            new[a], edge, count, last = True, -math.inf, 0, at
        while a < b:
            tops = np.maximum.accumulate(x1[a:b])
            before = np.empty(b - a)
            before[0] = edge
            np.maximum(tops[:-1], edge, out=before[1:])
            far = x0[a:b] - before > wide
            far[0] &= not new[a]
            k = int(far.argmax()) if far.any() else b - a
            reach[a : a + k] = before[:k]
            if k:
                edge = max(edge, float(tops[k - 1]))
                mean, count, rest = (mean, count, k) if count else (m, 1, k - 1)
                # Small multiples of 1/256 add up exactly: glyphs at the mean leave it as it is.
                if mean == m and (m * 256).is_integer() and abs(m) * 256 * (count + rest) < 2**53:
                    count, rest = count + rest, 0
                for count in range(count + 1, count + rest + 1):
                    mean = (mean * (count - 1) + m) / count
            a += k
            if a < b:
                new[a], edge, count = True, -math.inf, 0
    return new, reach


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in LINE.split(", ")]
    for batch in batches:
        lists = batch.column("glyphs")
        page = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
        glyph = lists.flatten()
        get = lambda name: glyph.field(name)  # noqa: B023, E731
        number = lambda name: get(name).fill_null(math.nan).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        whole = lambda name: get(name).fill_null(0).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        xa, ya, xb, yb = (number(c) for c in ("x0", "y0", "x1", "y1"))
        x0, y0, x1, y1 = np.minimum(xa, xb), np.minimum(ya, yb), np.maximum(xa, xb), np.maximum(ya, yb)
        usable = np.isfinite(x0) & np.isfinite(x1) & np.isfinite(y0) & np.isfinite(y1) & (y1 > y0)
        coded = get("text").dictionary_encode()
        blank = _by_value(coded, lambda t: not t or t.isspace())
        unit = _medians(page[usable], (y1 - y0)[usable], batch.num_rows)
        v = np.flatnonzero(usable & ~blank)
        page, x0, y0, x1, y1 = page[v], x0[v], y0[v], x1[v], y1[v]
        new, reach = _breaks(x0, x1, (y0 + y1) / 2, page, unit)
        line, at = np.cumsum(new) - 1, np.flatnonzero(new)
        m = len(at)
        if not m:
            continue

        # A space where white space was passed over or a gap is left, unless one stands there already.
        gone = np.cumsum(usable & blank)[v]
        apart = np.zeros(len(v), bool)
        apart[1:] = gone[1:] > gone[:-1]
        spaced = _by_value(coded, lambda t: t.endswith(" "))[v]
        space = ~new & (apart | (x0 - reach > WORD_SPACE * unit[page])) & ~np.concatenate(([False], spaced[:-1]))
        text = get("text")
        text = (text.fill_null("") if text.null_count else text).take(pa.array(v)).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(v) + 1]
        size = np.diff(offsets)
        out = np.full(int(size.sum() + space.sum()), 32, np.uint8)
        end = np.cumsum(size + space)
        shift = np.repeat(end - size - offsets[:-1], size)
        out[np.arange(len(shift)) + shift] = np.frombuffer(text.buffers()[2], np.uint8)[: len(shift)]
        cut = np.append((end - size - space)[at], len(out))
        texts = pa.LargeStringArray.from_buffers(m, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
        if spaced.any() or _by_value(coded, lambda t: len(t) > 1).any():
            texts = pa.array([t.strip() for t in texts.to_pylist()])

        sizes, height = np.nan_to_num(number("size"))[v], y1 - y0
        some = sizes > 0
        middle = _medians(line[some], sizes[some], m)
        font_size = np.where(np.isnan(middle), 0.92 * _medians(line, height, m), middle)
        share = lambda mark: np.bincount(line, mark, m) / np.bincount(line, minlength=m) > MAJORITY  # noqa: B023, E731
        flags, fonts = whole("flags")[v], get("font")
        heavy = (flags & BOLD != 0) | _by_value(fonts, lambda t: "bold" in t.lower())[v]
        slanted = (flags & ITALIC != 0) | _by_value(fonts, lambda t: "italic" in t.lower())[v]
        # The most frequent colour, the first seen of several; lines of one colour need no count.
        shade = whole("color")[v]
        color = shade[at]
        mixed = (np.minimum.reduceat(shade, at) != np.maximum.reduceat(shade, at))[line]
        if mixed.any():
            shade, of = shade[mixed], line[mixed]
            order = np.lexsort((np.arange(len(of)), shade, of))
            head = np.flatnonzero(np.concatenate(([True], (np.diff(shade[order]) != 0) | (np.diff(of[order]) != 0))))
            count = np.diff(np.append(head, len(order)))
            best = np.lexsort((order[head], -count, of[order[head]]))
            best = order[head[best[np.concatenate(([True], np.diff(of[order[head[best]]]) != 0))]]]
            color = color.copy()
            color[of[best]] = shade[best]
        box = [f.reduceat(c, at) for f, c in ((np.minimum, x0), (np.minimum, y0), (np.maximum, x1), (np.maximum, y1))]
        first = np.searchsorted(page[at], np.arange(batch.num_rows))
        ids = [batch.column(c).take(pa.array(page[at])) for c in PAGE]
        columns = [*ids, pa.array((np.arange(m) - first[page[at]]).astype(np.int32)), texts, *map(pa.array, box), pa.array(np.maximum(font_size, 1.0)), pa.array(color.astype(np.int32)), pa.array(share(heavy)), pa.array(share(slanted))]
        yield pa.record_batch(columns, names=names)


def lines_of_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, line_id, text, x0, y0, x1, y1, font_size, color, bold, italic) of ``pages``(doc_id, page_index, glyphs); nothing is moved.

    Corners of a box may stand in any order; boxes that are not finite or have no height are
    left out. Missing sizes, fonts, colours and flags count as 0 and empty. White space never
    begins a line, so a page of white space has none.
    """
    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), F.col("glyphs").cast(GLYPHS).alias("glyphs")).mapInArrow(_lines, LINE)


def lines(glyphs: DataFrame) -> DataFrame:
    """``lines_of_pages`` from one row a glyph (doc_id, page_index, pos, text, x0, y0, x1, y1, size, font, color, flags)."""
    return lines_of_pages(pages(glyphs))


def starts_list_item(text: Column) -> Column:
    return strip(text).rlike(LIST_MARKER)


def number_blocks(lines: list[dict]) -> list[int]:
    """Block of each of a page's lines, in order of line_id.

    A line goes on with the block above it where weight and size agree, it is no list item,
    overlaps, and the gap is positive and small against the block's leading: the median
    distance of its tops so far, or 1.2 sizes before there is one.
    """
    ids: list[int] = []
    gaps: list[float] = []
    for above, line in zip([None, *lines], lines):
        joins = above is not None and not line["item"] and line["bold"] == above["bold"]
        if joins:
            half = len(gaps) // 2
            leading = (gaps[half] if len(gaps) % 2 else (gaps[half - 1] + gaps[half]) / 2) if gaps else 1.2 * above["font_size"]
            sizes = sorted((line["font_size"], above["font_size"]))
            gap = line["y0"] - above["y1"]
            narrow = min(line["x1"] - line["x0"], above["x1"] - above["x0"])
            shared = min(line["x1"], above["x1"]) - max(line["x0"], above["x0"])
            joins = sizes[1] / max(sizes[0], 0.01) < SIZE_JUMP and above["y0"] - above["y1"] < gap < leading * SAME_PARAGRAPH and narrow > 0 and shared / narrow > MINIMUM_OVERLAP
        if not joins:
            gaps = []
        elif line["y0"] > above["y0"]:
            insort(gaps, line["y0"] - above["y0"])
        ids.append((ids[-1] if joins else ids[-1] + 1) if ids else 0)
    return ids


_FOLDED = ("line_id", "x0", "y0", "x1", "y1", "font_size", "bold", "item")


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [number_blocks(page) for page in batch.column("folded").to_pylist()]
        yield batch.drop_columns("folded").append_column("blocks", pa.array(found, pa.list_(pa.int32())))


def block_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``block_id`` within their page. One shuffle of lines; a page's lines stand in one row while it is folded."""
    item = starts_list_item(F.col("text")).alias("item")
    rest = [c for c in lines.columns if c not in (*PAGE, *_FOLDED)]
    whole = F.struct(*(item if c == "item" else F.col(c) for c in _FOLDED), *rest)
    rows = lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(whole)).alias("lines"))
    rows = rows.withColumn("folded", F.transform("lines", lambda x: F.struct(*(x[c].alias(c) for c in _FOLDED))))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    done = rows.mapInArrow(_numbers, f"doc_id {kinds['doc_id']}, page_index {kinds['page_index']}, lines {kinds['lines']}, blocks array<int>")
    flat = done.select(*PAGE, F.posexplode("lines").alias("_n", "_line"), "blocks")
    return flat.select(*(F.col(c) if c in PAGE else F.col(f"_line.{c}") for c in lines.columns), F.get("blocks", F.col("_n")).alias("block_id"))


def joined_text(parts: Column) -> Column:
    """Lines as one text: a single hyphen at a line's end is taken out, otherwise a space joins."""

    def step(done: Column, line: Column) -> Column:
        hyphen = done.endswith("-") & ~done.endswith("--")
        return F.when(hyphen, F.concat(F.substring(done, F.lit(1), F.length(done) - 1), line)).otherwise(F.concat(done, F.lit(" "), line))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.coalesce(F.get(parts, F.lit(0)), F.lit("")), step)


def blocks(lines: DataFrame) -> DataFrame:
    """One row per block of ``lines`` (with block_id): text, box, size, leading, style, alignment."""
    key = (*PAGE, "block_id")
    order = Window.partitionBy(*key).orderBy("line_id")
    last = F.max("line_id").over(Window.partitionBy(*key))
    top = Window.partitionBy(*key).orderBy("y0", "line_id")
    rows = lines.withColumn("last", last == F.col("line_id")).withColumn("gap", F.col("y0") - F.lag("y0").over(top)).withColumn("n", F.row_number().over(order))
    stripped = F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda x: strip(x["text"]))
    size = F.coalesce(F.expr("median(font_size) FILTER (WHERE font_size > 0)"), F.lit(11.0))
    many = F.count("*")
    spread = lambda a: F.coalesce(F.max(a) - F.min(a), F.lit(0.0))
    letters = F.length("text")
    weight = lambda c: F.sum(F.when(F.col(c), letters).otherwise(0)) / F.greatest(F.sum(letters), F.lit(1)) > MAJORITY
    # The colour of most letters, the first seen of several: windows inside the block's own partition.
    of_color = Window.partitionBy(*key, "color")
    rows = rows.withColumn("_w", F.sum(letters).over(of_color)).withColumn("_p", F.min("line_id").over(of_color))
    color = F.max_by("color", F.struct("_w", -F.col("_p"))).alias("color")
    one_height = F.first("y1") - F.first("y0")
    out = rows.groupBy(*key).agg(
        joined_text(stripped).alias("text"), many.alias("n_lines"), color, *box_of(), size.alias("font_size"), F.median("font_size").alias("_mid"), weight("bold").alias("bold"), weight("italic").alias("italic"),
        F.when(many < 2, F.when(one_height != 0, one_height)).otherwise(F.expr("median(gap) FILTER (WHERE gap > 0)")).alias("_leading"),
        spread(F.col("x0")).alias("_l"), spread((F.col("x0") + F.col("x1")) / 2).alias("_c"), spread(F.col("x1")).alias("_r2"), spread(F.when(~F.col("last"), F.col("x1"))).alias("_r3"),
    )
    right, tolerance = F.when(F.col("n_lines") >= 3, F.col("_r3")).otherwise(F.col("_r2")), F.col("_mid") * EDGE_TOLERANCE
    alignment = F.when((F.col("n_lines") < 2) | (F.col("_l") <= tolerance), "left").when((F.col("_c") <= tolerance) & (F.col("_c") < right), "centre").when(right <= tolerance, "right").otherwise("left")
    out = out.withColumn("line_height", F.coalesce("_leading", F.col("font_size") * 1.2)).withColumn("alignment", alignment)
    return out.select(*key, "text", "n_lines", "x0", "y0", "x1", "y1", "font_size", "line_height", "color", "bold", "italic", "alignment")


BLOCK = (
    "doc_id long, page_index int, block_id int, text string, n_lines long, x0 double, y0 double, x1 double, y1 double, font_size double, line_height double, color int, bold boolean, italic boolean, alignment string"
)
_ITEM = re.compile(r"[•·‣▪◦⁃∙*]|[-–—]\s|\(?\d{1,2}[.)]\s|\(?[a-z][.)]\s|\(?[ivx]{1,4}[.)]\s")


def _block(lines: list[dict]) -> list:
    """What ``blocks`` gives for one block's lines in order of line_id, without its key."""
    text, letters = lines[0]["text"].strip(), [len(x["text"]) for x in lines]
    for x in lines[1:]:
        text = (text[:-1] if text.endswith("-") and not text.endswith("--") else text + " ") + x["text"].strip()
    weight: dict[int, int] = {}
    for x, n in zip(lines, letters):
        weight[x["color"]] = weight.get(x["color"], 0) + n
    total = max(sum(letters), 1)
    share = lambda name: sum(n for x, n in zip(lines, letters) if x[name]) / total > MAJORITY
    left, right = [x["x0"] for x in lines], [x["x1"] for x in lines]
    tops, high = sorted(x["y0"] for x in lines), max(x["y1"] for x in lines)
    middle = statistics.median(x["font_size"] for x in lines)
    size = statistics.median([x["font_size"] for x in lines if x["font_size"] > 0] or [11.0])
    if len(lines) < 2:
        leading, alignment = lines[0]["y1"] - lines[0]["y0"], "left"
    else:
        gaps = [b - a for a, b in zip(tops, tops[1:]) if b > a]
        leading = statistics.median(gaps) if gaps else 0
        spread = lambda a: max(a) - min(a)
        tolerance, centre, edge = middle * EDGE_TOLERANCE, spread([(a + b) / 2 for a, b in zip(left, right)]), spread(right[:-1] if len(lines) >= 3 else right)
        alignment = "left" if spread(left) <= tolerance else "centre" if centre <= tolerance and centre < edge else "right" if edge <= tolerance else "left"
    return [text, len(lines), min(left), tops[0], max(right), high, size, leading or size * 1.2, max(weight, key=weight.__getitem__), share("bold"), share("italic"), alignment]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of batches of whole pages' lines."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in BLOCK.split(", ")])
    for batch in batches:
        out = []
        rows = (dict(zip(batch.schema.names, row)) for row in zip(*(c.to_pylist() for c in batch.columns)))
        for key, page in groupby(rows, key=lambda x: (x["doc_id"], x["page_index"])):
            lines = list(page)
            for x in lines:
                x["item"] = _ITEM.match(x["text"].strip()) is not None
            for block, members in groupby(zip(number_blocks(lines), lines), key=lambda x: x[0]):
                out.append([*key, block, *_block([x for _, x in members])])
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def page_blocks(rows: DataFrame, reader: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``blocks(block_lines(lines_of_pages(...)))`` of the whole pages that ``reader`` makes of batches of ``rows``, in one pass.

    Glyphs and lines stay inside the Python worker, and as a page is whole there nothing is
    moved. A reader gives batches (doc_id, page_index, glyphs): a grid, a decoder.
    """
    return rows.mapInArrow(lambda batches: _blocks(_lines(reader(batches))), BLOCK)
