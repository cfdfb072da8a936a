"""Streaming forms of the engine.

Segmentation is a projection, so it runs on a stream as it does on a table. Cache upkeep is
a windowed aggregate: uses of a sentence, with late rows bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.segment import segment
from folioflow.operators.translate import exploded


def piece_stream(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pieces of streamed texts, in append mode; texts without pieces give no row."""
    return exploded(texts, key).filter("pos IS NOT NULL")


def sentence_uses(texts: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, sentence, uses) of a stream with an event time: what a translation cache should hold."""
    timed = texts.withWatermark(time, late)
    pieces = timed.select(time, F.explode(segment(F.col("text"))).alias("p")).filter("p.translatable")
    return pieces.groupBy(F.window(time, window), F.col("p.text").alias("sentence")).agg(F.count("*").alias("uses"))
