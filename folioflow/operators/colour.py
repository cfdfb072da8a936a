"""Colours of scanned blocks, from pixels joined to sample points.

``pixels`` is (page, px, py, r, g, b), ``boxes`` (page, box_id, x0, y0, x1, y1) in points;
``scale`` is pixels per point. Points outside the page find no pixel and drop out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ring margin by height and at least, steps per side, samples per axis.
MARGIN, LEAST_MARGIN, ROW_STEPS, COLUMN_STEPS, MOST_SAMPLES = 0.35, 3.0, 12, 6, 64
KEY = ("page", "box_id")


def _walk(start: Column, end: Column, step: Column) -> Column:
    """start, start + step, ... up to end; empty where end is before start."""
    last = F.floor((end - start) / step + 1e-9).cast("int")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("k"), (start + k * step).alias("v")))).otherwise(F.array().cast("array<struct<k:int,v:double>>"))


def _looked_up(points: DataFrame, pixels: DataFrame, scale: float) -> DataFrame:
    at = points.withColumn("px", F.rint(F.col("x") * scale).cast("int")).withColumn("py", F.rint(F.col("y") * scale).cast("int"))
    return at.join(pixels, ["page", "px", "py"])


def background(boxes: DataFrame, pixels: DataFrame, scale: float) -> DataFrame:
    """(page, box_id, r, g, b) in 0..1: the mean of the fullest colour bucket around each box, white without pixels."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    margin = F.greatest(height * MARGIN, F.lit(LEAST_MARGIN))
    across = _walk(F.col("x0"), F.col("x1"), F.greatest(width / ROW_STEPS, F.lit(1.0)))
    down = _walk(F.col("y0"), F.col("y1"), F.greatest(height / COLUMN_STEPS, F.lit(1.0)))
    row = lambda n, y: F.transform(across, lambda p: F.struct((p["k"] + n * 100_000).alias("seq"), p["v"].alias("x"), y.alias("y")))
    column = lambda n, x: F.transform(down, lambda p: F.struct((p["k"] + n * 100_000).alias("seq"), x.alias("x"), p["v"].alias("y")))
    ring = F.concat(row(0, F.col("y0") - margin), row(1, F.col("y1") + margin), column(2, F.col("x0") - margin), column(3, F.col("x1") + margin))
    found = _looked_up(boxes.select(*KEY, F.explode(ring).alias("p")).select(*KEY, "p.*"), pixels, scale)
    bucket = [F.floor(F.col(c) / 16).cast("int").alias(f"b_{c}") for c in "rgb"]
    per = found.groupBy(*KEY, *bucket).agg(F.count("*").alias("n"), F.min("seq").alias("first"), *(F.avg(c).alias(c) for c in "rgb"))
    best = per.groupBy(*KEY).agg(F.max_by(F.struct("r", "g", "b"), F.struct("n", -F.col("first"))).alias("c"))
    return boxes.select(*KEY).join(best, list(KEY), "left").select(*KEY, *(F.coalesce(F.col(f"c.{c}") / 255, F.lit(1.0)).alias(c) for c in "rgb"))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def step(span: Column, scale: float) -> Column:
    """Points per pixel, or more where that would be over MOST_SAMPLES samples."""
    return F.greatest(F.lit(1.0), F.greatest(span * scale, F.lit(1.0)) / MOST_SAMPLES) / scale


def ink(boxes: DataFrame, backgrounds: DataFrame, pixels: DataFrame, scale: float) -> DataFrame:
    """(page, box_id, r, g, b) in 0..1: the pixel that contrasts most with the background, black without pixels."""
    xs = _walk(F.col("x0"), F.col("x1"), step(F.col("x1") - F.col("x0"), scale))
    ys = _walk(F.col("y0"), F.col("y1"), step(F.col("y1") - F.col("y0"), scale))
    points = boxes.select("*", F.explode(ys).alias("py_")).select("*", F.explode(xs).alias("px_"))
    points = points.select(*KEY, (F.col("py_.k") * 100_000 + F.col("px_.k")).alias("seq"), F.col("px_.v").alias("x"), F.col("py_.v").alias("y"))
    found = _looked_up(points, pixels, scale).withColumn("luma", F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000))
    pixel = F.struct("r", "g", "b")
    per = found.groupBy(*KEY).agg(F.min_by(pixel, F.struct("luma", "seq")).alias("dark"), F.max_by(pixel, F.struct("luma", -F.col("seq"))).alias("bright"))
    lit = backgrounds.select(*KEY, (luminance(F.col("r"), F.col("g"), F.col("b")) > 0.5).alias("light"))
    out = lit.join(per, list(KEY), "left").withColumn("c", F.when(F.col("light"), F.col("dark")).otherwise(F.col("bright")))
    return out.select(*KEY, *(F.coalesce(F.col(f"c.{c}") / 255, F.lit(0.0)).alias(c) for c in "rgb"))
