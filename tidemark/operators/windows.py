"""Window frames that Spark lacks: GROUPS frames and EXCLUDE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, keys: list[str], order: list[Column], before: int, after: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over GROUPS BETWEEN `before` PRECEDING AND `after` FOLLOWING.

    Peer groups are numbered by dense_rank; a RANGE frame over that number is the frame of groups.
    """
    numbered = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy("_g").rangeBetween(-before, after)
    return numbered.withColumns({name: a.over(w) for name, a in aggregates.items()}).drop("_g")


def sum_excluding_row(value: str, w) -> Column:
    """sum over a frame that has the current row, EXCLUDE CURRENT ROW; null when nothing remains."""
    x = F.col(value)
    left = F.count(x).over(w) - F.when(x.isNull(), 0).otherwise(1)
    return F.when(left > 0, F.sum(x).over(w) - F.coalesce(x, F.lit(0)))


def sum_excluding_group(value: str, keys: list[str], order: list[str]) -> Column:
    """sum over the whole partition, EXCLUDE GROUP: the total less that of the peers."""
    x, all_, peers = F.col(value), Window.partitionBy(*keys), Window.partitionBy(*keys, *order)
    left = F.count(x).over(all_) - F.count(x).over(peers)
    return F.when(left > 0, F.sum(x).over(all_) - F.coalesce(F.sum(x).over(peers), F.lit(0)))


def sum_excluding_ties(value: str, keys: list[str], order: list[str]) -> Column:
    """sum over the whole partition, EXCLUDE TIES: the peers go, the row itself stays."""
    x, all_, peers = F.col(value), Window.partitionBy(*keys), Window.partitionBy(*keys, *order)
    left = F.count(x).over(all_) - F.count(x).over(peers) + F.when(x.isNull(), 0).otherwise(1)
    return F.when(left > 0, F.sum(x).over(all_) - F.coalesce(F.sum(x).over(peers), F.lit(0)) + F.coalesce(x, F.lit(0)))


def extreme_excluding_row(value: str, w, before: int, after: int, largest: bool) -> Column:
    """min or max over ROWS BETWEEN `before` PRECEDING AND `after` FOLLOWING EXCLUDE CURRENT ROW: that of the rows before and of those after.

    w: the window with its partition and order, without a frame.
    """
    best, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    return pick(best(value).over(w.rowsBetween(-before, -1)), best(value).over(w.rowsBetween(1, after)))
