"""The folder that all machines of the cluster see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; only where that is unset (tests, one machine) a temporary folder, which is then set."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read back: made once, whatever reads it, and kept if executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
