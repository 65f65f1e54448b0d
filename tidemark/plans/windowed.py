"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import windows

from .registry import dialect, plan, sql

sql(
    "win_rank_family",
    "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders",
)
sql(
    "win_ntile_pct_cume",
    "SELECT p_partkey, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS quarter, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS cd FROM part",
)
sql(
    "win_lag_lead",
    "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
sql(
    "win_first_last_nth",
    "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER w AS last, nth_value(o_orderkey, 3) OVER w AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
sql(
    "win_aggregates",
    "SELECT s_suppkey, round(avg(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS mean, count(*) OVER (PARTITION BY s_nationkey) AS n, min(s_acctbal) OVER (PARTITION BY s_nationkey) AS lo, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS hi FROM supplier",
)
sql(
    "win_group_concat",
    "SELECT n_nationkey, array_join(collect_list(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ',') AS names FROM nation",
    "SELECT n_nationkey, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS names FROM nation",
)
sql("win_rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS moving FROM orders")
sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part")
sql("win_range_default_peers", "SELECT p_partkey, sum(CAST(p_size AS BIGINT)) OVER (PARTITION BY p_brand ORDER BY p_size) AS upto FROM part")
sql("win_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
sql("win_named", "SELECT o_orderkey, count(*) OVER w AS n, CAST(rank() OVER w AS BIGINT) AS r FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_custkey)")
sql(
    "win_filter_agg",
    "SELECT o_orderkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey) AS f FROM orders",
    "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS f FROM orders",
)
sql("win_nulls_order", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST) AS BIGINT) AS r FROM orders")


@plan(
    "win_groups_frame",
    "SELECT p_partkey, sum(CAST(p_size AS BIGINT)) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near_sum, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near_count FROM part",
)
def _groups(spark, t):
    made = windows.groups_frame(t["part"], ["p_brand"], [F.asc("p_size")], 1, 1, {"near_sum": F.sum(F.col("p_size").cast("long")), "near_count": F.count("*")})
    return made.select("p_partkey", "near_sum", "near_count")


@plan(
    "win_exclude_current",
    "SELECT p_partkey, sum(CAST(p_size AS BIGINT)) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS others FROM part",
)
def _exclude_current(spark, t):
    w = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(-1, 1)
    return t["part"].withColumn("v", F.col("p_size").cast("long")).select("p_partkey", windows.sum_excluding_row("v", w).alias("others"))


@plan(
    "win_exclude_group",
    "SELECT p_partkey, sum(CAST(p_size AS BIGINT)) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS others FROM part",
)
def _exclude_group(spark, t):
    return t["part"].withColumn("v", F.col("p_size").cast("long")).select("p_partkey", windows.sum_excluding_group("v", ["p_brand"], ["p_size"]).alias("others"))


@plan(
    "win_exclude_ties",
    "SELECT p_partkey, sum(CAST(p_size AS BIGINT)) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS others FROM part",
)
def _exclude_ties(spark, t):
    return t["part"].withColumn("v", F.col("p_size").cast("long")).select("p_partkey", windows.sum_excluding_ties("v", ["p_brand"], ["p_size"]).alias("others"))


@plan(
    "win_exclude_current_max",
    "SELECT p_partkey, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS others FROM part",
)
def _exclude_current_max(spark, t):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return t["part"].select("p_partkey", windows.extreme_excluding_row("p_size", w, 2, 2, True).alias("others"))


dialect(
    "dialect_groups_frame",
    "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near_sum, count(*) OVER (PARTITION BY p_brand ORDER BY p_size DESC GROUPS 2 PRECEDING) AS upto FROM part WHERE p_retailprice > 950",
    "SELECT p_partkey, sum(CAST(p_size AS BIGINT)) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near_sum, count(*) OVER (PARTITION BY p_brand ORDER BY p_size DESC GROUPS 2 PRECEDING) AS upto FROM part WHERE p_retailprice > 950",
)
dialect(
    "dialect_exclude",
    """SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS a,
        max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS b,
        count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS c,
        min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS d,
        count(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS e FROM part""",
    """SELECT p_partkey, sum(CAST(p_size AS BIGINT)) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS a,
        max(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS b,
        count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS c,
        min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS d,
        count(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS e FROM part""",
)


sql(
    "tumbling_window_superset",
    "SELECT date_format(window.start, 'yyyy-MM-dd HH:mm') AS at, event_type, count(*) AS n FROM events GROUP BY window(ts, '6 hours'), event_type",
    "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS at, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
