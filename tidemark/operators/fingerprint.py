"""An order-independent fingerprint of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, fingerprint. Row hashes are added, not exclusive-ored, so repeated rows do not cancel; sums of parts add up to that of the whole."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))
