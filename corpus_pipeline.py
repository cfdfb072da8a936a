"""A corpus from raw documents to packed training sequences.

Every stage but the last returns the columns of its input, whatever further columns there
are and whatever they are called. Nulls in any column are allowed: a null text is empty, a
row with a null id goes through every stage. Rows are judged one by one, also where an id is
repeated, with the same text or another; ties go to the smaller id. Texts are read whole, so
very long ones cost memory in one task but are neither cut nor skipped before packing. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, neardup, substring, toxicity
from folioflow.llm._spark import durable, read, remainder
from folioflow.llm.queries import labels_of, pack_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity score does not reject."""
    return toxicity.clean(docs, labels_of(spark, sf_dir, "toxic"), remainder(F.col("doc_id"), 3) == 1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class.

    Rows go one by one: where an id has several texts, each is classed by its own. Rows
    without an id stay, and so do rows that repeat the id of their class's first document.
    """
    gone = neardup.near_duplicates(docs).filter("doc_id is not null and not kept").select("doc_id", "text_hash").distinct()
    same = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without passages that an earlier document has; unchanged texts stay as they are."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    done = substring.remove_repeats(docs, carry=others, rejoin=False)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*(new.get(c, F.col(f"extra.{c}")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: kNN scores and bin packing have none. The tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
