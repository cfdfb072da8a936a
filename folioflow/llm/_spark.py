"""Session helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources import spread
from folioflow.storage import discard, durable

__all__ = ["discard", "durable", "read", "remainder"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def remainder(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus
