"""Top rows of each group, and pages of a table with its row count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each group before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def page(df: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """One page, numbered from 1, with the total of all rows; sizes are held to 1 to 10000."""
    size = min(max(size, 1), 10_000)
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size).crossJoin(F.broadcast(total))
