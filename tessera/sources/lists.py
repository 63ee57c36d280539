"""Vectors from JSON files that hold a list of lists of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_vectors(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(path, vector_id, vector): each file's lists in order, numbered from ``start`` in each file.

    A file is one JSON value, read whole.  A file that holds anything else raises; an
    empty list gives no rows, and a null element a null vector.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    lists = F.from_json("value", "array<array<float>>", {"mode": "FAILFAST"})
    return text.select("path", F.posexplode(lists).alias("place", "vector")).select("path", (F.col("place") + F.lit(start)).cast("long").alias("vector_id"), "vector")
