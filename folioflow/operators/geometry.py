"""Boxes and page frames as columns. A box is struct<x0, y0, x1, y1>, y downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), SIDES)))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def middle_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def middle_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def is_finite(b: Column) -> Column:
    """True where no side is null, not a number or infinite."""
    out = F.lit(True)
    for n in SIDES:
        out = out & F.coalesce(~F.isnan(b[n]) & (F.abs(b[n]) != float("inf")), F.lit(False))
    return out


def grown(b: Column, dx: Column, dy: Column) -> Column:
    """``b`` wider by dx and higher by dy on each side; negative values shrink it."""
    return box(b["x0"] - dx, b["y0"] - dy, b["x1"] + dx, b["y1"] + dy)


def union(a: Column, b: Column) -> Column:
    """The smallest box around both; a null box adds nothing."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"])))


def page_box(page_width: Column, page_height: Column) -> Column:
    """A page's frame with its origin at zero."""
    return box(F.lit(0.0), F.lit(0.0), page_width, page_height)


def upright(pages: DataFrame) -> DataFrame:
    """``pages(width, height, rotation)``, sizes as shown, with sizes and frame as drawn: rotation 0, the old one in ``shown_rotation``.

    A quarter turn swaps the sides. Everything between ``upright`` and ``restored`` is in the
    coordinates that drawing uses.
    """
    turn = F.pmod(F.coalesce("rotation", F.lit(0)), F.lit(360))
    lying = turn.isin(90, 270)
    w, h = F.when(lying, F.col("height")).otherwise(F.col("width")), F.when(lying, F.col("width")).otherwise(F.col("height"))
    return pages.withColumns({"width": w, "height": h, "rotation": F.lit(0), "shown_rotation": turn, "frame": page_box(w, h)})


def restored(pages: DataFrame) -> DataFrame:
    """The way back from ``upright``."""
    lying = F.col("shown_rotation").isin(90, 270)
    w, h = F.when(lying, F.col("height")).otherwise(F.col("width")), F.when(lying, F.col("width")).otherwise(F.col("height"))
    return pages.withColumns({"width": w, "height": h, "rotation": F.col("shown_rotation")}).drop("shown_rotation", "frame")
