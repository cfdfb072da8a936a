"""Sources of the engine."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of ``folder``; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Scan tasks of a table that is still dealt anew; at the default task size that moves 4 GB at most.
FEW_TASKS = 32


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give only a few tasks, as one small file does.

    For inputs of any size beyond that it changes nothing and moves nothing, whatever the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df.rdd.getNumPartitions() < min(cores, FEW_TASKS) else df


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(directory, file, path, length) of all files below ``folder``, in any store that Spark reads; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("directory"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "path", "length")


def first_set(*values: str | None) -> str | None:
    """The first value that is set: an override, a bundled place, a found one."""
    return next((v for v in values if v), None)
