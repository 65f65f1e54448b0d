"""How named queries are told: SQL for Spark, SQL for DuckDB, or a function that builds the DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.parquet_dir import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in Spark SQL; without an oracle of its own the same text runs in both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        load(spark, sf_dir, text)
        return spark.sql(text)

    QUERIES[name] = run
    ORACLES[name] = text if oracle is None else oracle


def plan(name: str, oracle: str | None):
    """Registers a function of (spark, tables); tables are read on first use."""

    def register(build: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(spark, load(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def dialect(name: str, text: str, oracle: str) -> None:
    """A query in the embedded dialect, translated on its way to Spark."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidemark.session import Engine

        return Engine(spark).attach_parquet(sf_dir).sql(text)

    QUERIES[name] = run
    ORACLES[name] = oracle
