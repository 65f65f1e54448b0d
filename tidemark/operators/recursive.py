"""Recursive common table expressions that Spark SQL lacks or would iterate row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.folders import shared_folder


def series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """What a counting recursion gives, without recursion: column x."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).select(F.col("id").alias("x"))


def _cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 10_000) -> DataFrame:
    """Recursive UNION: applies `step` to the rows that are new until none is. Each round is checkpointed to the shared folder."""
    seen = fresh = _cut(base.distinct())
    for _ in range(most):
        keys = [F.col(f"_n.{c}").eqNullSafe(F.col(f"_s.{c}")) for c in base.columns]
        made = step(fresh).toDF(*base.columns).distinct()
        fresh = _cut(made.alias("_n").join(seen.alias("_s"), keys, "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = _cut(seen.union(fresh))
    raise RuntimeError(f"no fixpoint after {most} rounds")
