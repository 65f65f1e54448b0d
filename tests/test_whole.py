import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tidemark.operators import joins
from tidemark.sources.parquet_dir import TABLES


@pytest.fixture(scope="module")
def tables():
    """Small tables with keys on both sides of every filter that the checked queries have."""
    rng = random.Random(13)
    return {
        "part": [{"p_partkey": k, "p_size": rng.randint(1, 6), "p_retailprice": round(rng.uniform(900, 960), 2)} for k in range(1, 121)],
        "orders": [{"o_orderkey": k, "o_totalprice": round(rng.uniform(89_000, 97_000), 2)} for k in range(1, 201)],
        "customer": [{"c_custkey": k, "c_name": f"c{k}", "c_nationkey": k % 5} for k in range(150, 260)],
        "supplier": [{"s_suppkey": k, "s_name": f"s{k}", "s_nationkey": k % 7} for k in range(1, 15)],
        "lineitem": [{"l_partkey": k} for k in (2, 3, 7, 90, 90)],
    }


def _run(spark, folder, tables, name):
    for t in TABLES:
        pq.write_table(pa.Table.from_pylist(tables.get(t, [{"nothing": 1}])), f"{folder}/{t}.parquet")
    return sorted(tuple(r) for r in entry.queries()[name](spark, str(folder)).collect())


def test_range_join_of_all_orders(spark, tables, tmp_path):
    want = sorted((p["p_partkey"], o["o_orderkey"]) for p in tables["part"] for o in tables["orders"] if p["p_retailprice"] <= o["o_totalprice"] / 100 <= p["p_retailprice"] + 2)
    assert any(o % 50 for _, o in want)
    assert _run(spark, tmp_path, tables, "join_theta_range") == want


def test_using_join_of_all_customers(spark, tables, tmp_path):
    want = sorted((c["c_nationkey"], c["c_name"], s["s_name"]) for c in tables["customer"] for s in tables["supplier"] if c["c_nationkey"] == s["s_nationkey"])
    assert _run(spark, tmp_path, tables, "join_using") == want


@pytest.mark.parametrize(("more", "n"), [([], 116), ([1], 0)])
def test_not_in_of_all_lines(spark, tables, tmp_path, more, n):
    lines = tables["lineitem"] + [{"l_partkey": k} for k in more]
    assert _run(spark, tmp_path, tables | {"lineitem": lines}, "join_anti_not_in_null") == [(n,)]


def test_box_join_of_all_boxes(spark, tables, tmp_path):
    boxes = [(p["p_partkey"], p["p_size"], p["p_size"] + 1, p["p_retailprice"], p["p_retailprice"] + 3) for p in tables["part"]]
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4])
    assert any(a % 10 for a, _ in want)
    assert _run(spark, tmp_path, tables, "rtree_box_join") == want


def test_using_join_is_dealt_by_pairs(spark, tmp_path):
    tables = {"customer": [{"c_custkey": k, "c_name": "same", "c_nationkey": 3} for k in range(4000)], "supplier": [{"s_suppkey": k, "s_name": f"s{k}", "s_nationkey": 3} for k in range(3000)]}
    for t, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), f"{tmp_path}/{t}.parquet")
    made = entry.queries()["join_using"](spark, str(tmp_path)).selectExpr("spark_partition_id() AS task", "s_name").groupBy("task").count().collect()
    assert sum(r["count"] for r in made) == 12_000_000
    assert max(r["count"] for r in made) < 4_000_000


@pytest.mark.parametrize("seed", range(3))
def test_dealt_join_of_busy_and_lone_keys(spark, seed, monkeypatch):
    monkeypatch.setattr(joins, "TASK_PAIRS", 50)
    monkeypatch.setattr(joins, "BLOCK", 4)
    rng = random.Random(seed)
    # Key 0 is busy on both sides, 1 on the left, 2 on the right; the rest, null among them, have few rows or one side only. Rows repeat.
    left = [(rng.choice([0, 0, 0, 1, 1, 2, None, 3, rng.randint(4, 30)]), rng.choice(["a", "b", None])) for _ in range(200)]
    right = [(rng.choice([0, 0, 0, 2, 2, 1, None, 99, rng.randint(4, 30)]), rng.choice(["x", "y", None])) for _ in range(150)]
    found = joins.dealt_join(spark.createDataFrame(left, "k INT, a STRING"), spark.createDataFrame(right, "k INT, b STRING"), "k")
    assert found.columns == ["k", "a", "b"]
    assert Counter(map(tuple, found.collect())) == Counter((k, a, b) for k, a in left for j, b in right if k is not None and k == j)
