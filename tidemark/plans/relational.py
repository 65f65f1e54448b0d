"""Scans, filters, joins, aggregates, sorting, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins, recursive, topk

from .registry import ORACLES, dialect, plan, sql

# Scans and filters.

sql(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
        round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
sql("scan_project", "SELECT c_custkey, c_name, c_acctbal * 1.1 AS raised, upper(c_mktsegment) AS segment FROM customer")
sql("scan_count", "SELECT count(*) AS n, sum(CAST(length(text) AS BIGINT)) AS letters FROM documents")
sql("point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 4711")
sql("filter_compare", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND l_returnflag <> 'N'")
sql("filter_between_in", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size NOT BETWEEN 14 AND 16 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')")
dialect("filter_like_ci", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%RE%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RE%'")
dialect("filter_glob", "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#[1-3]?'", "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand#[1-3]?'")
dialect("filter_null_safe", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT 'O'", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'")
sql("filter_is_null", "SELECT count(*) AS n FROM (SELECT nullif(o_orderpriority, '1-URGENT') AS p FROM orders) t WHERE p IS NULL")
sql(
    "case_iif_coalesce",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class,
        CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END AS first_brand, if(p_size % 2 = 0, 'even', 'odd') AS parity, coalesce(nullif(p_type, 'X'), 'none') AS kind FROM part""",
)
dialect("bitwise_ops", "SELECT p_partkey, p_size & 7 AS a, p_size | 8 AS b, ~p_size AS c, p_size << 2 AS d, p_size >> 1 AS e FROM part", "SELECT p_partkey, p_size & 7 AS a, p_size | 8 AS b, ~p_size AS c, p_size << 2 AS d, p_size >> 1 AS e FROM part")
dialect("row_value_compare", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_custkey) < ('O', 500)", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_custkey) < ('O', 500)")
sql("collate_nocase", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) COLLATE UTF8_LCASE = 'BUILDING'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
sql("concat_operator", "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS STRING) AS place, n_name || nullif(n_name, n_name) AS nothing FROM nation", "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS VARCHAR) AS place, n_name || nullif(n_name, n_name) AS nothing FROM nation")
sql("values_source", "SELECT column1, column2 FROM VALUES (1, 'a'), (2, 'b'), (3, 'c') AS t(column1, column2)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS t(column1, column2)")
sql("constant_select", "SELECT 6 * 7 AS answer, 'x' AS letter")

# Joins.

sql("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
sql("join_right", "SELECT c_custkey, count(o_orderkey) AS n FROM (SELECT * FROM orders WHERE o_totalprice > 250000) o RIGHT JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey")
sql("join_full", "SELECT s_nationkey, c_nationkey, count(*) AS n FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey < 15) s FULL OUTER JOIN (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey > 8) c ON s_nationkey = c_nationkey GROUP BY s_nationkey, c_nationkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
@plan("join_using", "SELECT k, c_name, s_name FROM (SELECT c_nationkey AS k, c_name FROM customer) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)")
def _join_using(spark, t):
    return joins.dealt_join(t["customer"].selectExpr("c_nationkey AS k", "c_name"), t["supplier"].selectExpr("s_nationkey AS k", "s_name"), "k")


sql("join_natural", "SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM nation) b")
sql("join_self", "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql(
    "join_multiway_star",
    """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01' GROUP BY r_name, n_name""",
)
sql("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("join_semi_in", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)")
sql("join_anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2000-01-01')")
@plan("join_anti_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def _not_in(spark, t):
    return joins.not_in(t["part"].select("p_partkey"), t["lineitem"].where("l_quantity > 40"), "p_partkey", "l_partkey")


@plan("join_anti_not_in_null", "SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT nullif(l_partkey, 1) FROM lineitem)")
def _not_in_null(spark, t):
    listed = t["lineitem"].selectExpr("nullif(l_partkey, 1) AS k")
    return joins.not_in(t["part"], listed, "p_partkey", "k").agg(F.count("*").alias("n"))


@plan("join_theta_range", "SELECT p_partkey, o_orderkey FROM part JOIN orders ON o_totalprice / 100 BETWEEN p_retailprice AND p_retailprice + 2")
def _join_theta_range(spark, t):
    prices = t["orders"].select("o_orderkey", (F.col("o_totalprice") / 100).alias("at"))
    spans = t["part"].select("p_partkey", F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 2).alias("high"))
    return joins.range_join(spans, prices, "low", "high", "at", width=2.0).select("p_partkey", "o_orderkey")


@plan(
    "join_asof_events",
    """SELECT p.event_id, v.ts AS view_ts, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = (SELECT max(event_type) FROM events)) p
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def _join_asof(spark, t):
    return _asof(t)


def _asof(t, slices=None):
    ends = t["events"].agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = t["events"].crossJoin(F.broadcast(ends))
    left = e.where("event_type = hi").select("event_id", "user_id", "ts")
    right = e.where("event_type = lo").groupBy("user_id", "ts").agg(F.max("value").alias("view_value"))
    found = joins.asof_join(left, right, "ts", by=["user_id"], right_time="view_ts", slices=slices)
    return found.select("event_id", "view_ts", "view_value")


@plan("join_asof_sliced", ORACLES["join_asof_events"])
def _join_asof_sliced(spark, t):
    return _asof(t, lambda ts: F.date_trunc("day", ts))


sql(
    "lateral_topk",
    "SELECT n_name, s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) t",
)

# Aggregates.

sql("agg_global", "SELECT count(*) AS n, count(nullif(p_size, 1)) AS sized, min(p_size) AS lo, max(p_size) AS hi, sum(CAST(p_size AS BIGINT)) AS total, round(avg(p_retailprice), 4) AS mean FROM part")
sql("agg_group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 15")
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT CAST(l_quantity AS BIGINT)) AS quantities FROM lineitem GROUP BY l_returnflag")
sql("agg_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) AS large, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY o_orderstatus")
dialect("agg_total", "SELECT c_mktsegment, total(CASE WHEN c_acctbal > 99999 THEN c_acctbal END) AS total FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, coalesce(sum(CAST(CASE WHEN c_acctbal > 99999 THEN c_acctbal END AS DOUBLE)), 0.0) AS total FROM customer GROUP BY c_mktsegment")
sql("agg_group_concat_ordered", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql("agg_bare_column_max", "SELECT o_custkey, max(o_totalprice) AS top, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_totalprice) AS top, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top_order FROM orders GROUP BY o_custkey")
sql("agg_json_group_array", "SELECT n_regionkey, to_json(array_sort(collect_list(n_nationkey))) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS keys FROM nation GROUP BY n_regionkey")
sql("agg_json_group_object", "SELECT n_regionkey, to_json(map_from_entries(array_sort(collect_list(struct(n_name, n_nationkey))))) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS names FROM nation GROUP BY n_regionkey")
sql("agg_group_ordinal_alias", "SELECT p_brand AS brand, p_size > 25 AS large, count(*) AS n FROM part GROUP BY 1, large")
sql("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("agg_approx_superset", "SELECT l_returnflag, percentile(l_quantity, 0.5) AS median FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY l_returnflag")
sql("rollup_superset", "SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_size < 6 GROUP BY ROLLUP (p_brand, p_size)")
sql("cube_superset", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("grouping_sets_superset", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@plan("table_fingerprint", "SELECT count(*) AS rows_a, count(*) AS rows_b, true AS same FROM orders")
def _table_fingerprint(spark, t):
    from tidemark.operators.fingerprint import fingerprint

    a = fingerprint(t["orders"]).toDF("rows_a", "sum_a")
    b = fingerprint(t["orders"].repartition(7, "o_custkey")).toDF("rows_b", "sum_b")
    return a.crossJoin(b).select("rows_a", "rows_b", (F.col("sum_a") == F.col("sum_b")).alias("same"))


# Sorting and limits.

sql("order_nulls", "SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders) t ORDER BY s, o_orderkey LIMIT 40", "SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders) t ORDER BY s NULLS FIRST, o_orderkey LIMIT 40")
sql("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 25")
sql("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("order_expression", "SELECT p_partkey, p_size FROM part ORDER BY p_size % 7, 1 DESC LIMIT 30")


@plan("topk_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) t WHERE k <= 3")
def _topk_per_group(spark, t):
    return topk.per_group(t["orders"], ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@plan("page_with_total", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 50")
def _page_with_total(spark, t):
    return topk.page(t["customer"].select("c_custkey", "c_name"), ["c_custkey"], page=2, size=50)


# Set operations and common table expressions.

sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("intersect_op", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
sql("except_op", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
sql("compound_left_assoc", "(SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 2) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 5")
sql("cte_multi", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 250000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey")
sql("cte_recursive_native", "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 60) SELECT x, x * x AS square FROM c")


@plan("cte_recursive_series", "SELECT range AS x, 'r' || range AS label FROM range(1, 2001)")
def _cte_recursive_series(spark, t):
    return recursive.series(spark, 1, 2000).select("x", F.concat(F.lit("r"), F.col("x")).alias("label"))


@plan(
    "cte_recursive_union_fixpoint",
    """WITH RECURSIVE g AS (SELECT DISTINCT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + 10) % 25 FROM nation WHERE n_nationkey % 5 = 0),
    r(k) AS (SELECT 0 UNION SELECT b FROM g JOIN r ON a = k) SELECT CAST(k AS BIGINT) AS k FROM r""",
)
def _fixpoint(spark, t):
    n = t["nation"].select(F.col("n_nationkey").cast("long").alias("a"))
    edges = n.select("a", ((F.col("a") * 3 + 1) % 25).alias("b")).union(n.where("a % 5 = 0").select("a", ((F.col("a") + 10) % 25).alias("b"))).distinct()
    return recursive.fixpoint(spark.range(1).select(F.col("id").alias("k")), lambda fresh: fresh.join(edges, F.col("k") == F.col("a")).select(F.col("b").alias("k")))


# Subqueries.

sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
sql("correlated_scalar", "SELECT p_partkey, (SELECT max(l_quantity) FROM lineitem WHERE l_partkey = p_partkey) AS most FROM part WHERE p_size = 5")
sql("derived_table", "SELECT bucket, count(*) AS n FROM (SELECT o_custkey, CAST(floor(sum(o_totalprice) / 500000) AS BIGINT) AS bucket FROM orders GROUP BY o_custkey) t GROUP BY bucket")
sql("exists_correlated", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY) GROUP BY o_orderpriority")
