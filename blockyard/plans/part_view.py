"""Rows of ``part`` for queries that make a document of each in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts for each task: a small file is one split, though the work on its rows is long.
TASK_ROWS = 10_000


def parts(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """The table's rows, or those ``only`` holds for, dealt out to tasks by their number and not by the files' bytes."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = rows if only is None else rows.where(only)
    return rows.repartition(max(1, -(-rows.count() // TASK_ROWS)), F.col("p_partkey"))
