"""Writes, transactions and history of versioned tables, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.session import Engine

from .registry import plan


def _supplier(spark, t, key: str | None = None):
    db = Engine(spark).open(":memory:")
    db.import_table("supplier", t["supplier"], key=key)
    return db


@plan("dml_insert_values", "SELECT * FROM (VALUES (1, 'a', 2.5::DOUBLE), (2, 'b', NULL), (3, 'c', 7.0)) v(id, name, price)")
def _insert_values(spark, t):
    db = Engine(spark).open(":memory:")
    db.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, name TEXT NOT NULL, price REAL); INSERT INTO items(name, price) VALUES ('a', 2.5), ('b', NULL); INSERT INTO items VALUES (3, 'c', 7)")
    return db.query("SELECT * FROM items")


@plan("dml_insert_select", "SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def _insert_select(spark, t):
    db = _supplier(spark, t)
    db.execute("CREATE TABLE per (k INTEGER, n INTEGER); INSERT INTO per SELECT s_nationkey, count(*) FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey")
    return db.query("SELECT * FROM per")


@plan("dml_update", "SELECT s_suppkey, CASE WHEN s_nationkey BETWEEN 3 AND 9 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _update(spark, t):
    db = _supplier(spark, t)
    db.execute("UPDATE supplier SET s_acctbal = s_acctbal * 2 WHERE s_nationkey BETWEEN 3 AND 9")
    return db.query("SELECT s_suppkey, s_acctbal FROM supplier")


@plan("dml_update_from", "SELECT s_suppkey, s_name || '/' || n_name AS s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _update_from(spark, t):
    db = _supplier(spark, t)
    db.import_table("nation", t["nation"])
    db.execute("UPDATE supplier SET s_name = s_name || '/' || n_name FROM nation WHERE n_nationkey = s_nationkey")
    return db.query("SELECT s_suppkey, s_name FROM supplier")


@plan("dml_delete", "SELECT s_suppkey, s_name FROM supplier WHERE NOT (s_acctbal < 1000 OR s_nationkey = 7)")
def _delete(spark, t):
    db = _supplier(spark, t)
    db.execute("DELETE FROM supplier WHERE s_acctbal < 1000 OR s_nationkey = 7")
    return db.query("SELECT s_suppkey, s_name FROM supplier")


@plan("dml_upsert", "SELECT n_regionkey AS k, sum(1) AS n, max(n_name) AS last FROM nation GROUP BY 1 UNION ALL SELECT 99, 1, 'new'")
def _upsert(spark, t):
    db = Engine(spark).open(":memory:")
    db.import_table("nation", t["nation"])
    db.execute("CREATE TABLE c (k INTEGER PRIMARY KEY, n INTEGER, last TEXT); INSERT INTO c SELECT n_regionkey, 1, min(n_name) FROM nation GROUP BY n_regionkey")
    db.execute(
        "INSERT INTO c SELECT n_regionkey, count(*) - 1, max(n_name) FROM nation GROUP BY n_regionkey UNION ALL SELECT 99, 1, 'new' ON CONFLICT(k) DO UPDATE SET n = n + excluded.n, last = excluded.last"
    )
    return db.query("SELECT * FROM c")


@plan("dml_insert_or", "SELECT s_suppkey, CASE WHEN s_suppkey BETWEEN 1 AND 3 THEN 'replaced' ELSE s_name END AS s_name FROM supplier")
def _insert_or(spark, t):
    db = _supplier(spark, t, key="s_suppkey")
    db.execute("INSERT OR IGNORE INTO supplier(s_suppkey, s_name) VALUES (1, 'ignored'), (2, 'ignored'); INSERT OR REPLACE INTO supplier(s_suppkey, s_name) VALUES (1, 'replaced'), (2, 'replaced'), (3, 'replaced')")
    return db.query("SELECT s_suppkey, s_name FROM supplier")


@plan("dml_returning", "SELECT s_suppkey, round(s_acctbal + 1, 2) AS after FROM supplier WHERE s_nationkey = 3")
def _returning(spark, t):
    db = _supplier(spark, t)
    return db.execute("UPDATE supplier SET s_acctbal = s_acctbal + 1 WHERE s_nationkey = 3 RETURNING s_suppkey, round(s_acctbal, 2) AS after")


@plan("tx_rollback_invisible", "SELECT count(*) AS inside, (SELECT count(*) FROM supplier) AS after, (SELECT count(*) FROM supplier) AS other FROM supplier WHERE s_nationkey <> 3")
def _rollback(spark, t):
    db = _supplier(spark, t)
    other = Engine(spark).open(db.store.root, mode="fresh", read_only=True)
    db.execute("BEGIN; DELETE FROM supplier WHERE s_nationkey = 3")
    inside, seen = db.query("SELECT count(*) AS inside FROM supplier"), other.query("SELECT count(*) AS other FROM supplier")
    db.execute("ROLLBACK")
    return inside.crossJoin(db.query("SELECT count(*) AS after FROM supplier")).crossJoin(seen)


@plan("tx_savepoint", "SELECT count(*) AS n FROM supplier WHERE s_nationkey <> 3")
def _savepoint(spark, t):
    db = _supplier(spark, t)
    db.execute("BEGIN; DELETE FROM supplier WHERE s_nationkey = 3; SAVEPOINT a; DELETE FROM supplier; ROLLBACK TO a; COMMIT")
    return db.query("SELECT count(*) AS n FROM supplier")


@plan("snapshot_time_travel", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0")
def _time_travel(spark, t):
    db = _supplier(spark, t)
    db.execute("DELETE FROM supplier WHERE s_suppkey % 2 = 1")
    there = db.generation
    db.execute("DELETE FROM supplier; INSERT INTO supplier(s_suppkey, s_name) VALUES (1, 'later')")
    return db.at(there).sql("SELECT s_suppkey, s_name FROM supplier")


@plan("change_feed", "SELECT s_suppkey, 'delete' AS change FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 100000, 'insert'")
def _change_feed(spark, t):
    db = _supplier(spark, t)
    first = db.generation
    db.execute("DELETE FROM supplier WHERE s_nationkey = 3; INSERT INTO supplier(s_suppkey, s_name) VALUES (100000, 'x')")
    return db.changes(first, table="supplier").select("s_suppkey", F.col("_change").alias("change"))


@plan("vacuum_preserves", "SELECT count(*) AS n, sum(s_suppkey) AS keys, 1 AS files FROM supplier")
def _vacuum(spark, t):
    db = _supplier(spark, t)
    for k in range(3):
        db.execute(f"INSERT INTO supplier(s_suppkey) VALUES ({-k - 1})")
    db.execute("DELETE FROM supplier WHERE s_suppkey < 0; VACUUM")
    files = db.status()["files"]
    return db.query("SELECT count(*) AS n, sum(s_suppkey) AS keys FROM supplier").withColumn("files", F.lit(files))


@plan("schema_catalog", "SELECT * FROM (VALUES ('table', 'a', 'a'), ('view', 'v', 'v'), ('index', 'ix', 'a')) t(type, name, tbl_name)")
def _catalog(spark, t):
    db = Engine(spark).open(":memory:")
    db.execute("CREATE TABLE a (id INTEGER PRIMARY KEY, v TEXT); CREATE VIEW v AS SELECT id FROM a; CREATE INDEX ix ON a(v)")
    return db.query("SELECT type, name, tbl_name FROM sqlite_schema")


@plan("pragma_table_info", "SELECT * FROM (VALUES (0, 'sku', 'INTEGER', 0, 1), (1, 'label', 'TEXT', 1, 0), (2, 'weight', 'REAL', 0, 0), (3, 'photo', 'BLOB', 0, 0)) t(cid, name, type, \"notnull\", pk)")
def _table_info(spark, t):
    db = Engine(spark).open(":memory:")
    db.execute("CREATE TABLE goods (sku INTEGER PRIMARY KEY, label TEXT NOT NULL, weight REAL, photo BLOB)")
    return db.execute("PRAGMA table_info(goods)").drop("dflt_value")


@plan("ddl_alter", "SELECT r_regionkey AS id, r_name AS title, 5 AS stars FROM region")
def _alter(spark, t):
    db = Engine(spark).open(":memory:")
    db.import_table("r", t["region"])
    db.execute("ALTER TABLE r RENAME COLUMN r_name TO title; ALTER TABLE r RENAME COLUMN r_regionkey TO id; ALTER TABLE r ADD COLUMN stars INTEGER DEFAULT 5; ALTER TABLE r RENAME TO places")
    return db.query("SELECT id, title, stars FROM places")


@plan("ddl_view_generated", "SELECT r_regionkey AS id, r_regionkey * 2 AS twice FROM region WHERE r_regionkey > 1")
def _view_generated(spark, t):
    db = Engine(spark).open(":memory:")
    db.import_table("region", t["region"])
    db.execute("CREATE TABLE g (id INTEGER PRIMARY KEY, twice INTEGER GENERATED ALWAYS AS (id * 2) STORED); INSERT INTO g(id) SELECT r_regionkey FROM region WHERE r_regionkey > 0; CREATE VIEW big AS SELECT * FROM g WHERE id > 1")
    return db.query("SELECT id, twice FROM big")


@plan("dml_concurrent_append", "SELECT s_suppkey AS x, 1 AS n FROM supplier WHERE s_suppkey <> 7 UNION ALL SELECT 1000000 + k, 1 FROM (VALUES (1), (2), (3)) v(k)")
def _concurrent_append(spark, t):
    """Writers that began at one generation; whoever comes later gets later row ids."""
    first = Engine(spark).open(":memory:")
    first.execute("CREATE TABLE c (x INTEGER)")
    others = [Engine(spark).open(first.store.root) for _ in range(3)]
    first.import_table("supplier", t["supplier"])
    first.execute("INSERT INTO c SELECT s_suppkey FROM supplier")
    for k, db in enumerate(others):
        db.execute(f"INSERT INTO c VALUES ({1_000_001 + k})")
    last = Engine(spark).open(first.store.root)
    last.execute("VACUUM; DELETE FROM c WHERE x = 7")
    return last.query("SELECT x, count(rowid) AS n FROM c GROUP BY x")


@plan("dml_update_or", "SELECT * FROM (VALUES (1, 'a'), (4, 'b'), (9, 'd')) v(id, name)")
def _update_or(spark, t):
    db = Engine(spark).open(":memory:")
    db.execute("CREATE TABLE u (id INTEGER PRIMARY KEY, name TEXT); INSERT INTO u VALUES (1, 'a'), (2, 'b'), (4, 'c'), (5, 'd'); UPDATE OR IGNORE u SET id = 4 WHERE id = 1; UPDATE OR REPLACE u SET id = 4 WHERE id = 2; UPDATE u SET id = 9 WHERE id = 5")
    return db.query("SELECT id, name FROM u")


@plan("ddl_partial_unique", "SELECT r_regionkey AS k, 'kept' AS state FROM region UNION ALL SELECT 0, 'gone'")
def _partial_unique(spark, t):
    db = Engine(spark).open(":memory:")
    db.import_table("region", t["region"])
    db.execute("CREATE TABLE s (k INTEGER, state TEXT); CREATE UNIQUE INDEX one ON s(k) WHERE state = 'kept'; INSERT INTO s SELECT r_regionkey, 'kept' FROM region; INSERT INTO s VALUES (0, 'gone'); INSERT OR IGNORE INTO s VALUES (1, 'kept')")
    return db.query("SELECT k, state FROM s")


@plan("ddl_rename_kept", "SELECT r_regionkey AS num, r_regionkey * 3 AS triple FROM region WHERE r_regionkey >= 0")
def _rename(spark, t):
    db = Engine(spark).open(":memory:")
    db.import_table("region", t["region"])
    db.execute("CREATE TABLE a (k INTEGER CHECK (k >= 0), triple INTEGER AS (k * 3) STORED); CREATE UNIQUE INDEX ak ON a(k); ALTER TABLE a RENAME COLUMN k TO num; ALTER TABLE a RENAME TO b; INSERT INTO b(num) SELECT r_regionkey FROM region; DROP INDEX ak")
    return db.query("SELECT num, triple FROM b")


@plan("dml_foreign_keys", "SELECT n_nationkey AS id, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS region FROM nation WHERE n_regionkey <> 3")
def _foreign_keys(spark, t):
    db = Engine(spark).open(":memory:")
    for name in ("region", "nation"):
        db.import_table(name, t[name])
    db.execute(
        """PRAGMA foreign_keys = on; CREATE TABLE r (id INTEGER PRIMARY KEY); INSERT INTO r SELECT r_regionkey FROM region;
        CREATE TABLE hard (id INTEGER, region INTEGER REFERENCES r(id) ON DELETE CASCADE); CREATE TABLE soft (id INTEGER, region INTEGER REFERENCES r(id) ON DELETE SET NULL);
        INSERT INTO hard SELECT n_nationkey, n_regionkey FROM nation; INSERT INTO soft SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM r WHERE id IN (2, 3)"""
    )
    return db.query("SELECT id, region FROM soft WHERE id IN (SELECT id FROM hard) OR region IS NULL AND id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")


@plan("fn_changes", "SELECT 2 AS c, 5 AS t, 3 AS r")
def _changes(spark, t):
    db = Engine(spark).open(":memory:")
    db.execute("CREATE TABLE n (id INTEGER PRIMARY KEY, v TEXT); INSERT INTO n(v) VALUES ('a'), ('b'), ('c'); UPDATE n SET v = 'z' WHERE id > 1")
    return db.query("SELECT changes() AS c, total_changes() AS t, last_insert_rowid() AS r")


@plan("collate_column", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 HAVING c_mktsegment = 'BUILDING'")
def _collate_column(spark, t):
    db = Engine(spark).open(":memory:")
    db.import_table("customer", t["customer"].select("c_custkey", "c_mktsegment"))
    db.execute("CREATE TABLE s (segment TEXT COLLATE NOCASE); INSERT INTO s SELECT c_mktsegment FROM customer")
    return db.query("SELECT segment, count(*) AS n FROM s WHERE segment = 'building' GROUP BY segment")


@plan("file_statistics", "SELECT 'supplier' AS name, count(*) AS cells FROM supplier")
def _file_statistics(spark, t):
    db = _supplier(spark, t)
    return db.query("SELECT name, sum(ncell) AS cells FROM dbstat GROUP BY name")


@plan("bulk_insert_million", "SELECT count(*) AS n, sum(length('v' || range)) AS letters FROM range(1, 1000001)")
def _bulk_insert(spark, t):
    db = Engine(spark).open(":memory:")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, value TEXT); WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 1000000) INSERT INTO t SELECT x, 'v' || x FROM c")
    return db.query("SELECT count(*) AS n, sum(length(value)) AS letters FROM t")


_POINTS: dict[str, str] = {}


@plan("point_select_by_key", "SELECT 777 AS id, 'v777' AS value")
def _point_select(spark, t):
    """A select by key from a table of many files, which is made once for each application: only files that can hold the key are opened."""
    application = spark.sparkContext.applicationId
    if application not in _POINTS:
        db = Engine(spark).open(":memory:")
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, value TEXT); WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 10000) INSERT INTO t SELECT x, 'v' || x FROM c")
        _POINTS[application] = db.store.root
    return Engine(spark).open(_POINTS[application], read_only=True).query("SELECT id, value FROM t WHERE id = 777")
