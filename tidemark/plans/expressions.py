"""Queries in the embedded dialect: arithmetic, casts, comparison and the scalar function families.

Each is told in the dialect and translated; the oracle says the same in DuckDB's own terms.
"""

from __future__ import annotations

from .registry import dialect

dialect(
    "int_div_mod_null",
    "SELECT p_partkey, p_size / 7 AS d, p_size % 7 AS m, p_size / (p_size - p_size) AS n, -p_size / 4 AS neg, p_retailprice / 2 AS r FROM part",
    "SELECT p_partkey, p_size // 7 AS d, p_size % 7 AS m, NULL AS n, CAST(trunc(-p_size / 4) AS INTEGER) AS neg, p_retailprice / 2 AS r FROM part",
)
dialect(
    "cast_prefix",
    "SELECT p_partkey, CAST(substr(p_brand, 7) || 'abc' AS INTEGER) AS a, CAST(p_name AS INTEGER) AS b, CAST('  2.5e1x' AS REAL) AS c, CAST(2.9 AS INTEGER) AS d, CAST(p_size AS TEXT) AS e FROM part",
    "SELECT p_partkey, CAST(substr(p_brand, 7) AS BIGINT) AS a, 0 AS b, 25.0::DOUBLE AS c, 2 AS d, CAST(p_size AS VARCHAR) AS e FROM part",
)
dialect("like_case_insensitive", "SELECT p_partkey FROM part WHERE p_brand LIKE 'bRAND#_1' AND p_type NOT LIKE '%zzz%'", "SELECT p_partkey FROM part WHERE p_brand ILIKE 'brand#_1' AND p_type NOT ILIKE '%zzz%'")
dialect("like_escape", "SELECT n_name FROM nation WHERE n_name || '%' LIKE '%!%' ESCAPE '!'", "SELECT n_name FROM nation")
dialect("glob_pattern", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[2-4]*' AND p_name NOT GLOB '*[^a-z ]*'", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[2-4]*' AND NOT p_name GLOB '*[!a-z ]*'")
dialect("dialect_row_values", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_custkey) >= ('O', 500)", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_custkey) >= ('O', 500)")
dialect("is_operator", "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS 'O' AS a, nullif(o_orderstatus, 'F') IS NOT NULL AS b, nullif(o_orderstatus, 'F') IS NOT 'P' AS c FROM orders", "SELECT o_orderkey, CAST(nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM 'O' AS INTEGER) AS a, CAST(nullif(o_orderstatus, 'F') IS NOT NULL AS INTEGER) AS b, CAST(nullif(o_orderstatus, 'F') IS DISTINCT FROM 'P' AS INTEGER) AS c FROM orders")
dialect("boolean_integers", "SELECT p_partkey, p_size > 25 AS big, TRUE AS yes, NOT (p_size = 1) AS other FROM part WHERE (p_size > 40) = TRUE", "SELECT p_partkey, CAST(p_size > 25 AS INTEGER) AS big, 1 AS yes, CAST(p_size <> 1 AS INTEGER) AS other FROM part WHERE p_size > 40")
dialect("quoted_identifiers", 'SELECT "p_partkey" AS "the key", [p_size] AS `the size` FROM "part" WHERE "p_size" = 3', 'SELECT p_partkey AS "the key", p_size AS "the size" FROM part WHERE p_size = 3')
dialect("dialect_compound", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 2 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 5", "(SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 2) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 5")
dialect("dialect_limit_forms", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5, 10", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5")
dialect("dialect_limit_negative", "SELECT n_name FROM nation ORDER BY n_name LIMIT -1", "SELECT n_name FROM nation")
dialect("dialect_values", "WITH v AS (VALUES (1, 'a'), (2, 'b')) SELECT column1 + 1 AS x, column2 AS y FROM v", "SELECT column1 + 1 AS x, column2 AS y FROM (VALUES (1, 'a'), (2, 'b')) v(column1, column2)")
dialect("dialect_materialized", "WITH t AS MATERIALIZED (SELECT p_size AS s FROM part WHERE p_size < 4) SELECT s, count(*) AS n FROM t GROUP BY s", "SELECT p_size AS s, count(*) AS n FROM part WHERE p_size < 4 GROUP BY 1")
dialect("dialect_recursive", "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 300) SELECT x FROM c", "SELECT range AS x FROM range(1, 301)")

dialect(
    "fn_string_basic",
    "SELECT c_custkey, length(c_name) AS n, upper(c_mktsegment) AS u, lower(c_name) AS l, instr(c_name, '#') AS i, replace(c_name, 'Customer', 'C') AS r, concat(c_custkey, '-', c_mktsegment) AS c, concat_ws('/', c_name, NULL, 'x') AS w FROM customer",
    "SELECT c_custkey, length(c_name) AS n, upper(c_mktsegment) AS u, lower(c_name) AS l, instr(c_name, '#') AS i, replace(c_name, 'Customer', 'C') AS r, concat(c_custkey, '-', c_mktsegment) AS c, concat_ws('/', c_name, NULL, 'x') AS w FROM customer",
)
dialect(
    "fn_substr_edge",
    "SELECT n_name, substr(n_name, 0, 3) AS a, substr(n_name, -3) AS b, substr(n_name, 3, -2) AS c, substr(n_name, 2, 3) AS d, substr(n_name, -2, 5) AS e FROM nation",
    "SELECT n_name, substring(n_name, 1, 2) AS a, right(n_name, 3) AS b, substring(n_name, 1, 2) AS c, substring(n_name, 2, 3) AS d, right(n_name, 2) AS e FROM nation",
)
dialect("fn_trim", "SELECT n_name, trim('xx' || n_name || 'x', 'x') AS a, ltrim('  ' || n_name) AS b, rtrim(n_name || '--', '-') AS c FROM nation", "SELECT n_name, trim('xx' || n_name || 'x', 'x') AS a, n_name AS b, n_name AS c FROM nation")
dialect("fn_printf", "SELECT n_nationkey, printf('%05d|%s|%.2f', n_nationkey, n_name, n_regionkey * 1.5) AS p FROM nation", "SELECT n_nationkey, printf('%05d|%s|%.2f', n_nationkey, n_name, n_regionkey * 1.5::DOUBLE) AS p FROM nation")
dialect("fn_hex_char", "SELECT n_nationkey, hex(n_name) AS h, char(65 + n_nationkey, 33) AS c, unicode(n_name) AS u, hex(zeroblob(3)) AS z FROM nation", "SELECT n_nationkey, hex(n_name) AS h, chr(65 + n_nationkey) || '!' AS c, unicode(n_name) AS u, '000000' AS z FROM nation")
dialect("fn_quote_typeof", "SELECT n_nationkey, quote(n_name || '''s') AS q, quote(NULL) AS qn, typeof(n_name) AS t, typeof(n_nationkey) AS i, typeof(1.5) AS r, typeof(NULL) AS n FROM nation", "SELECT n_nationkey, '''' || n_name || '''''s''' AS q, 'NULL' AS qn, 'text' AS t, 'integer' AS i, 'real' AS r, 'null' AS n FROM nation")
dialect("fn_scalar_minmax", "SELECT p_partkey, max(p_size, 25) AS a, min(p_size, 25, 10) AS b, max(p_size, NULL) AS c, abs(p_size - 25) AS d, sign(p_size - 25) AS e, iif(p_size > 25, 'hi', 'lo') AS f, ifnull(nullif(p_size, 7), -7) AS g FROM part", "SELECT p_partkey, greatest(p_size, 25) AS a, least(p_size, 25, 10) AS b, NULL AS c, abs(p_size - 25) AS d, sign(p_size - 25) AS e, CASE WHEN p_size > 25 THEN 'hi' ELSE 'lo' END AS f, ifnull(nullif(p_size, 7), -7) AS g FROM part")
dialect(
    "fn_math_trig",
    "SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(atan2(p_size, 3), 6) AS a, round(degrees(pi() / p_size), 6) AS d, round(radians(p_size), 6) AS r, acos(2) AS bad, sqrt(-p_size) AS nosqrt FROM part",
    "SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(atan2(p_size, 3), 6) AS a, round(degrees(pi() / p_size), 6) AS d, round(radians(p_size), 6) AS r, NULL AS bad, NULL AS nosqrt FROM part",
)
dialect(
    "fn_math_log_round",
    "SELECT p_partkey, round(log(p_size), 6) AS l, round(ln(p_size), 6) AS n, round(log2(p_size), 6) AS b, round(log(3, p_size), 6) AS t, power(p_size, 2) AS p, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, trunc(-p_retailprice) AS u, mod(p_size, 7) AS m, round(p_retailprice, 1) AS r FROM part",
    "SELECT p_partkey, round(log10(p_size), 6) AS l, round(ln(p_size), 6) AS n, round(log2(p_size), 6) AS b, round(ln(p_size) / ln(3), 6) AS t, power(p_size, 2) AS p, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, trunc(-p_retailprice) AS u, p_size % 7 AS m, round(p_retailprice, 1) AS r FROM part",
)
dialect(
    "fn_date_parts",
    "SELECT o_orderkey, date(o_orderdate) AS d, time(o_orderdate) AS t, datetime(o_orderdate) AS dt FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt FROM orders",
)
dialect(
    "fn_strftime",
    "SELECT event_id, strftime('%Y/%m/%d %H:%M', ts) AS a, strftime('%j', ts) AS j, strftime('%w', ts) AS w, strftime('%s', ts) AS s, strftime('%W', ts) AS wk FROM events",
    "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS a, strftime(ts, '%j') AS j, strftime(ts, '%w') AS w, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS s, strftime(ts, '%W') AS wk FROM events",
)
dialect(
    "fn_date_modifiers",
    "SELECT o_orderkey, date(o_orderdate, '+7 days') AS a, date(o_orderdate, 'start of month') AS b, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS c, date(o_orderdate, 'start of year', '+2 years') AS d, date(o_orderdate, 'weekday 0') AS e, date('2024-01-31', '+1 month') AS f, datetime(o_orderdate, '+90 minutes') AS g FROM orders",
    """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS a, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS b, strftime(last_day(o_orderdate), '%Y-%m-%d') AS c,
        strftime(date_trunc('year', o_orderdate) + INTERVAL 2 YEAR, '%Y-%m-%d') AS d, strftime(o_orderdate + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INTEGER)), '%Y-%m-%d') AS e, '2024-03-02' AS f,
        strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS g FROM orders""",
)
dialect("fn_julianday_epoch", "SELECT o_orderkey, julianday(o_orderdate) AS j, unixepoch(o_orderdate) AS u FROM orders", "SELECT o_orderkey, epoch(o_orderdate) / 86400 + 2440587.5 AS j, CAST(epoch(o_orderdate) AS BIGINT) AS u FROM orders")

dialect("json_extract_props", "SELECT event_id, json_extract(props, '$.k') AS k, json_extract(props, '$.none') AS none FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, NULL AS none FROM events")
dialect("json_arrow_ops", "SELECT event_id, props ->> '$.k' AS a, props ->> 'k' AS b, props -> '$.k' AS c FROM events", "SELECT event_id, props ->> '$.k' AS a, props ->> 'k' AS b, CAST(props -> '$.k' AS VARCHAR) AS c FROM events")
dialect("json_build", "SELECT n_nationkey, json_array(n_nationkey, n_name) AS a, json_object('key', n_nationkey, 'name', n_name) AS o FROM nation", "SELECT n_nationkey, CAST(json_array(n_nationkey, n_name) AS VARCHAR) AS a, CAST(json_object('key', n_nationkey, 'name', n_name) AS VARCHAR) AS o FROM nation")
dialect("json_valid_type", "SELECT event_id, json_valid(props) AS v, json_valid('{x') AS bad, json_type(props) AS t, json_type(props, '$.k') AS k, json_array_length('[1,2,3]') AS n FROM events", "SELECT event_id, 1 AS v, 0 AS bad, 'object' AS t, 'integer' AS k, 3 AS n FROM events")
dialect("json_each_expand", "SELECT event_id, j.key AS key, j.value AS value FROM events, json_each(props) AS j", "SELECT event_id, 'k' AS key, props ->> 'k' AS value FROM events")
dialect("json_mutate", "SELECT n_nationkey, json_set('{\"a\":1}', '$.b', n_nationkey) AS s, json_remove('{\"a\":1,\"b\":2}', '$.a') AS r, json_insert('{\"a\":1}', '$.a', 9) AS i, json_replace('{\"a\":1}', '$.a', n_name) AS p, json_patch('{\"a\":1,\"b\":2}', '{\"b\":null,\"c\":3}') AS q FROM nation", "SELECT n_nationkey, '{\"a\":1,\"b\":' || n_nationkey || '}' AS s, '{\"b\":2}' AS r, '{\"a\":1}' AS i, '{\"a\":\"' || n_name || '\"}' AS p, '{\"a\":1,\"c\":3}' AS q FROM nation")
dialect("dialect_aggregates", "SELECT n_regionkey, total(n_nationkey) AS t, group_concat(n_name, ';' ORDER BY n_name) AS g, count(*) FILTER (WHERE n_nationkey > 10) AS f FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(sum(n_nationkey) AS DOUBLE) AS t, string_agg(n_name, ';' ORDER BY n_name) AS g, count(*) FILTER (WHERE n_nationkey > 10) AS f FROM nation GROUP BY n_regionkey")
dialect("dialect_distinct_from", "SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
dialect("dialect_window_filter", "SELECT n_nationkey, count(*) FILTER (WHERE n_nationkey > 5) OVER (PARTITION BY n_regionkey) AS f, group_concat(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS g FROM nation", "SELECT n_nationkey, count(*) FILTER (WHERE n_nationkey > 5) OVER (PARTITION BY n_regionkey) AS f, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS g FROM nation")

# What the static types of the dialect decide.

dialect(
    "dialect_values_expressions",
    "SELECT column1 AS id, column2 AS word FROM (VALUES (1, 'a' || char(960)), (2, upper('b')), (1 + 2, NULL))",
    "SELECT * FROM (VALUES (1, 'aπ'), (2, 'B'), (3, NULL)) v(id, word)",
)
dialect("dialect_char", "SELECT n_nationkey, char(960 + n_nationkey, 8364, 128512) AS c FROM nation", "SELECT n_nationkey, chr(960 + n_nationkey) || chr(8364) || chr(128512) AS c FROM nation")
dialect(
    "dialect_recursive_types",
    "WITH RECURSIVE c(x, y, z) AS (SELECT 1, 1, 'a' UNION ALL SELECT x + 1, y * 2 % 7, z || x FROM c WHERE x < 30) SELECT x, y, z FROM c",
    "WITH RECURSIVE c(x, y, z) AS (SELECT 1::BIGINT, 1::BIGINT, 'a' UNION ALL SELECT x + 1, y * 2 % 7, z || x FROM c WHERE x < 30) SELECT x, y, z FROM c",
)
dialect(
    "dialect_affinity",
    "SELECT p_partkey, '10' = 10 AS a, '10' > 10 AS b, 7 < 'x' AS c, p_size = '7' AS d, p_brand = 7 AS e FROM part",
    "SELECT p_partkey, 0 AS a, 1 AS b, 1 AS c, CAST(p_size = 7 AS INTEGER) AS d, 0 AS e FROM part",
)
dialect("dialect_overflow", "SELECT 9223372036854775807 + 1 AS a, -9223372036854775807 - 2 AS b, 4611686018427387904 * 2 AS c, 2147483647 + 1 AS d", "SELECT 9223372036854775808::DOUBLE AS a, -9223372036854775809::DOUBLE AS b, 9223372036854775808::DOUBLE AS c, 2147483648 AS d")
dialect(
    "dialect_not_in_subquery",
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) AND nullif(p_size, 3) NOT IN (SELECT s_nationkey FROM supplier)",
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) AND nullif(p_size, 3) NOT IN (SELECT s_nationkey FROM supplier)",
)
dialect("dialect_not_in_null", "SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT nullif(l_partkey, 1) FROM lineitem)", "SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT nullif(l_partkey, 1) FROM lineitem)")
dialect(
    "dialect_json_tree",
    """SELECT n_nationkey, t.fullkey AS fullkey, t.type AS type, t.atom AS atom FROM nation, json_tree('{"a":[1,' || n_nationkey || '],"b":{"c":"x"}}') AS t""",
    """SELECT n_nationkey, fullkey, type, CASE WHEN fullkey = '$.a[1]' THEN CAST(n_nationkey AS VARCHAR) ELSE atom END AS atom FROM nation,
        (VALUES ('$', 'object', NULL), ('$.a', 'array', NULL), ('$.a[0]', 'integer', '1'), ('$.a[1]', 'integer', ''), ('$.b', 'object', NULL), ('$.b.c', 'text', 'x')) v(fullkey, type, atom)""",
)
dialect("dialect_generate_series", "SELECT n_nationkey, s.value AS v FROM nation, generate_series(1, 9, 4) AS s", "SELECT n_nationkey, s.v AS v FROM nation, (VALUES (1), (5), (9)) s(v)")
dialect(
    "fn_unhex_soundex",
    "SELECT n_nationkey, hex(unhex('41FF')) AS u, soundex(n_name) IS NOT NULL AS s, like('%a%', lower(n_name)) AS l, glob('*A*', n_name) AS g, length(randomblob(5)) AS r FROM nation",
    "SELECT n_nationkey, '41FF' AS u, 1 AS s, CAST(contains(lower(n_name), 'a') AS INTEGER) AS l, CAST(contains(n_name, 'A') AS INTEGER) AS g, 5 AS r FROM nation",
)
