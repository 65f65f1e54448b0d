"""A directory with one Parquet file or folder for each table."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables(Mapping):
    """Tables by name; a table is opened when it is first asked for."""

    def __init__(self, spark: SparkSession, path: str, names: tuple[str, ...] = TABLES):
        self.spark, self.path, self.names = spark, path, names
        self.opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self.opened[name]

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def load(spark: SparkSession, path: str, text: str = "") -> Tables:
    """The tables of a directory; those that the text names become temporary views, in place of those of an earlier directory."""
    tables = Tables(spark, path)
    words = set(re.findall(r"\w+", text.lower()))
    for name in tables:
        if name in words:
            tables[name].createOrReplaceTempView(name)
    return tables
