"""What can stop a document or a page, as codes in rows and a dimension of messages.

Expected outcomes are never raised inside tasks: operators leave a code in ``error_code``,
and reports join it with what to tell the reader and what to do about it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.catalog import values


class Failure(NamedTuple):
    code: str
    message: str
    recovery: str
    #: Whether the rest of the document still goes through.
    soft: bool


FAILURES = (
    Failure("CANCELLED", "The run was stopped.", "", False),
    Failure("NO_ROUTE", "No chain of models leads from this language to the target.", "Install a model for the pair, or for a way through a third language.", False),
    Failure("MODEL_MISSING", "A model of the route is not installed.", "Fetch the missing model directory.", False),
    Failure("MODEL_LOAD_FAILED", "A model of the route could not be loaded.", "Fetch the model directory again.", False),
    Failure("TRANSLATION_FAILED", "Some sentences could not be translated and stay as they were.", "Run the document again.", True),
    Failure("CANNOT_OPEN", "The file could not be opened.", "Check that it is a complete document.", False),
    Failure("ENCRYPTED", "The file asks for a password.", "Save a copy without a password.", False),
    Failure("NO_PAGES", "The document has no pages.", "", False),
    Failure("NO_TEXT", "No text was found.", "If it is a scan, install text recognition.", False),
    Failure("NO_TEXT_AFTER_OCR", "No text was found, and recognition read none.", "Scan it again at a higher resolution.", False),
    Failure("OCR_UNAVAILABLE", "Scanned pages could not be read.", "Install text recognition and its language data.", True),
    Failure("RENDERING_FAILED", "A page could not be drawn.", "", False),
    Failure("CANNOT_WRITE", "The output could not be written.", "Check the folder and its free space.", False),
    Failure("FONT_NOT_FOUND", "No installed font covers the target's script.", "Install a font for the script.", False),
    Failure("SHAPING_UNAVAILABLE", "The target's script cannot be shaped here.", "", True),
)


def dimension(spark) -> DataFrame:
    """(error_code, message, recovery, soft)"""
    return values(spark, list(FAILURES), "error_code string, message string, recovery string, soft boolean")


def display(message: Column, recovery: Column) -> Column:
    """The message, and what to do about it on a line of its own."""
    return F.when(F.coalesce(recovery, F.lit("")) == "", message).otherwise(F.concat(message, F.lit("\n"), recovery))


def described(rows: DataFrame) -> DataFrame:
    """``rows(error_code)`` with message, recovery, soft and display; an unknown code is its own message, no code has none."""
    known = F.broadcast(dimension(rows.sparkSession))
    out = rows.join(known, "error_code", "left").withColumn("message", F.coalesce("message", "error_code"))
    return out.withColumn("display", display(F.col("message"), F.col("recovery")))


def first_failure(*codes: Column) -> Column:
    """The first code that is set, in the order of the steps."""
    return F.coalesce(*codes)
