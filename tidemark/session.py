"""Sessions: `Engine` runs statements over a directory of Parquet tables or opens versioned databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.plans import dialect
from tidemark.plans.script import kind

_TYPES = {T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "real", T.DoubleType: "real", T.DecimalType: "real", T.StringType: "text", T.BinaryType: "blob", T.BooleanType: "bool", T.TimestampType: "ts", T.TimestampNTZType: "ts", T.DateType: "ts"}


def column_types(df: DataFrame) -> dialect.Types:
    return {f.name: _TYPES.get(type(f.dataType)) for f in df.schema.fields}


def run_query(spark: SparkSession, text: str, tables: dict[str, DataFrame], args: dict | list | None = None, counters: dict[str, int] | None = None) -> DataFrame:
    """A query in the dialect over these tables. They are bound as temporary views while the query is analysed."""
    lower = text.lower()
    # Tables that the text does not name are not opened.
    found = {name.lower(): tables[name] for name in tables if name.lower() in lower}

    def catalog(name: str) -> dialect.Types | None:
        return column_types(found[name.lower()]) if name.lower() in found else None

    made = dialect.translate(text, catalog, counters)
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    if made.uses_edit:
        from tidemark.functions import jsons

        jsons.register(spark)
    for f in made.fixpoints:
        from tidemark.operators.recursive import fixpoint

        def step(fresh: DataFrame, f: dialect.Fixpoint = f) -> DataFrame:
            fresh.createOrReplaceTempView(f.name)
            return spark.sql(f.step)

        fixpoint(spark.sql(f.base).toDF(*f.columns), step).createOrReplaceTempView(f.name)
    return spark.sql(made.sql, args=args) if args else spark.sql(made.sql)


class Session:
    """Statements over fixed tables, read only."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        if kind(text) != "query":
            raise dialect.DialectError("these tables are read only")
        return run_query(self.spark, text, self.tables, args)


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def attach_parquet(self, path: str) -> Session:
        """Every known table of a directory, as it is."""
        from tidemark.sources.parquet_dir import TABLES, Tables

        return Session(self.spark, Tables(self.spark, path, TABLES))

    def open(self, root: str = ":memory:", mode: str = "snapshot", read_only: bool = False, single_writer: bool = False):
        """A versioned database; ':memory:' has a temporary root of its own in the cluster's shared folder.

        single_writer: asserts that nobody else writes, for stores that cannot order several writers' commits.
        """
        from tidemark.database import Database

        return Database(self.spark, root, mode=mode, read_only=read_only, single_writer=single_writer)
