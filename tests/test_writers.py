"""Several writers, keys, files and their ranges."""

import random

import pytest

from tidemark import database
from tidemark.database import ConstraintError, Database
from tidemark.plans import prune
from tidemark.plans.script import DialectError
from tidemark.session import Engine
from tidemark.sources.log import WriteConflict
from tidemark.sources.store import ArrowStore, HadoopStore, LocalStore, Unordered


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark).open(str(tmp_path / "db"))


def test_row_ids_of_concurrent_appends(spark, db):
    db.execute("CREATE TABLE t (x INTEGER)")
    other = Engine(spark).open(db.store.root)
    db.execute("INSERT INTO t VALUES (1)")
    other.execute("INSERT INTO t VALUES (2)")
    assert other.last_rowid == 2
    last = Engine(spark).open(db.store.root)
    assert rows(last.query("SELECT rowid, x FROM t")) == [(1, 1), (2, 2)]
    last.execute("VACUUM; DELETE FROM t WHERE x = 1")
    assert rows(last.query("SELECT rowid, x FROM t")) == [(2, 2)]
    last.execute("INSERT INTO t VALUES (3)")
    assert rows(last.query("SELECT rowid, x FROM t")) == [(2, 2), (3, 3)]


def test_many_writers_in_turn(spark, db):
    """Every acknowledged row is there once, whatever the writers' snapshots were."""
    db.execute("CREATE TABLE t (x INTEGER, w INTEGER)")
    rng, want = random.Random(3), set()
    writers = [Engine(spark).open(db.store.root) for _ in range(4)]
    for k in range(12):
        w = rng.randrange(4)
        writers[w].execute(f"INSERT INTO t VALUES ({k}, {w})")
        want.add(k)
        if k == 5:
            keeper = Engine(spark).open(db.store.root)
            keeper.execute("VACUUM; UPDATE t SET w = -1 WHERE x = 2; DELETE FROM t WHERE x = 4")
            want.discard(4)
    last = Engine(spark).open(db.store.root)
    got = rows(last.query("SELECT x, rowid FROM t"))
    assert [x for x, _ in got] == sorted(want) and len({i for _, i in got}) == len(got)
    last.execute("UPDATE t SET w = 100 + x")
    assert rows(last.query("SELECT w - x FROM t")) == [(100,)] * len(want)


def test_a_transaction_of_inserts_and_updates_is_renumbered(spark, db):
    db.execute("CREATE TABLE t (x INTEGER); INSERT INTO t VALUES (0)")
    other = Engine(spark).open(db.store.root)
    other.execute("BEGIN; INSERT INTO t VALUES (10), (11); UPDATE t SET x = x + 100 WHERE x >= 10")
    db.execute("INSERT INTO t VALUES (1), (2)")
    other.execute("COMMIT")
    got = rows(Engine(spark).open(db.store.root).query("SELECT rowid, x FROM t"))
    assert [x for _, x in got] == [0, 1, 2, 110, 111] and [i for i, _ in got] == [1, 2, 3, 4, 5]


def test_the_change_feed_of_renumbered_files(spark, db):
    db.execute("CREATE TABLE t (x INTEGER)")
    other = Engine(spark).open(db.store.root)
    db.execute("INSERT INTO t VALUES (1)")
    other.execute("INSERT INTO t VALUES (2)")
    there = other.generation
    other.execute("VACUUM")
    assert rows(other.changes(there, table="t")) == []
    other.execute("UPDATE t SET x = 20 WHERE x = 2")
    assert rows(other.changes(there, table="t").select("_rowid", "x", "_change")) == [(2, 2, "delete"), (2, 20, "insert")]


def test_keys_of_two_writers_conflict(spark, db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    other = Engine(spark).open(db.store.root)
    db.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(WriteConflict):
        other.execute("INSERT INTO t VALUES (1)")


@pytest.mark.parametrize("most", [0, 1000])
def test_sizes_and_ranges_whoever_reads_the_footers(spark, db, monkeypatch, most):
    monkeypatch.setattr(database, "MOST_FOOTERS", most)
    db.import_table("t", spark.range(0, 6_000, 1, 6).selectExpr("id AS k", "concat('v', id) AS v", "IF(id < 3000, NULL, id / 2) AS r"))
    files = db.state["tables"]["t"]["files"]
    assert len(files) == 6 and all(f["bytes"] > 0 and f["rows"] == 1000 for f in files.values())
    key = db.state["tables"]["t"]["columns"][0]["id"]
    assert sorted(f["ranges"][key] for f in files.values()) == [[k, k + 999] for k in range(0, 6_000, 1_000)]


def test_vacuum_writes_files_of_a_size(spark, db, monkeypatch):
    db.import_table("t", spark.range(0, 40_000, 1, 8).selectExpr("id AS k", "sha2(string(id), 256) AS v"))
    size = sum(f["bytes"] for f in db.state["tables"]["t"]["files"].values())
    monkeypatch.setattr(database, "VACUUM_BYTES", size // 3)
    before = rows(db.query("SELECT sum(k), count(DISTINCT v), max(rowid) FROM t"))
    db.execute("VACUUM")
    ranges = sorted(f["ranges"]["_rowid"] for f in db.state["tables"]["t"]["files"].values())
    assert 3 <= len(ranges) <= 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert rows(db.query("SELECT sum(k), count(DISTINCT v), max(rowid) FROM t")) == before


def _opened(db, text):
    return {f.rpartition("/")[2] for f in db.query(text).inputFiles()}


def test_files_that_cannot_hold_a_row_are_not_opened(spark, db):
    db.import_table("t", spark.range(0, 8_000, 1, 8).selectExpr("id AS k", "concat('n', lpad(id, 5, '0')) AS v"))
    for where, files, n in (
        ("k = 4711", 1, 1),
        ("k BETWEEN 1990 AND 2010", 2, 21),
        ("5 > k AND k >= 3", 1, 2),
        ("k IN (1, 7999)", 2, 2),
        ("v = 'n00042'", 1, 1),
        ("k = 1 OR k = 7999", 8, 2),
        ("rowid <= 1", 1, 1),
        ("k = 99999", 0, 0),
        ("k > 6500 AND CASE WHEN k = 1 THEN 0 ELSE 1 END", 8, 1499),
        ("NOT k < 7990", 8, 10),
    ):
        text = f"SELECT k FROM t WHERE {where}"
        assert len(_opened(db, text)) == files, where
        assert db.query(text).count() == n, where
    assert len(_opened(db, "SELECT a.k FROM t AS a JOIN t AS b ON a.k = b.k WHERE a.k = 3")) == 8
    held = dict(db.state["tables"]["t"]["files"])
    db.execute("UPDATE t SET v = 'x' WHERE k = 4711; DELETE FROM t WHERE k < 10")
    assert len(held.keys() & db.state["tables"]["t"]["files"].keys()) == 6
    assert rows(db.query("SELECT count(*), min(k) FROM t")) == [(7990, 10)]


def test_conditions_that_are_sure():
    told = prune.conditions("SELECT * FROM t AS q WHERE q.a = -3 AND (b = 2 OR c = 1) AND 'x' <= d AND e = f AND g IN (1, 'y') ORDER BY a")
    assert told == ("t", [("a", "=", -3), ("d", ">=", "x"), ("g", "IN", [1, "y"])])
    for text in ("SELECT 1", "SELECT * FROM a, b WHERE a.x = 1", "SELECT * FROM a WHERE x IN (SELECT y FROM b WHERE y = 1)", "UPDATE a SET x = 1 FROM b WHERE y = 2"):
        assert not (prune.conditions(text) or ("", []))[1]


def test_foreign_keys_on_the_parents_side(db):
    db.execute(
        """CREATE TABLE p (id INTEGER PRIMARY KEY, code TEXT UNIQUE); INSERT INTO p VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd');
        CREATE TABLE strict (p INTEGER REFERENCES p); CREATE TABLE falls (p INTEGER REFERENCES p(id) ON DELETE CASCADE ON UPDATE CASCADE, x INTEGER);
        CREATE TABLE clears (code TEXT DEFAULT 'd' REFERENCES p(code) ON DELETE SET DEFAULT);
        INSERT INTO strict VALUES (1); INSERT INTO falls VALUES (2, 20), (2, 21), (3, 30); INSERT INTO clears VALUES ('b'), ('a'); PRAGMA foreign_keys = on"""
    )
    with pytest.raises(ConstraintError, match="FOREIGN KEY"):
        db.execute("DELETE FROM p WHERE id = 1")
    with pytest.raises(ConstraintError, match="FOREIGN KEY"):
        db.execute("UPDATE p SET id = 9 WHERE id = 1")
    db.execute("DELETE FROM p WHERE id = 2; UPDATE p SET id = 33 WHERE id = 3")
    assert rows(db.query("SELECT id FROM p")) == [(1,), (4,), (33,)]
    assert rows(db.query("SELECT * FROM falls")) == [(33, 30)]
    assert rows(db.query("SELECT * FROM clears")) == [("a",), ("d",)]


def test_partial_expression_and_dropped_unique_indexes(db):
    db.execute("CREATE TABLE t (a TEXT, live INTEGER); CREATE UNIQUE INDEX one ON t(lower(a)) WHERE live = 1; INSERT INTO t VALUES ('X', 1), ('x', 0), ('x', 0)")
    with pytest.raises(ConstraintError, match="UNIQUE"):
        db.execute("INSERT INTO t VALUES ('x', 1)")
    with pytest.raises(ConstraintError, match="UNIQUE"):
        db.execute("UPDATE t SET live = 1")
    db.execute("INSERT OR IGNORE INTO t VALUES ('x', 1), ('y', 1); DROP INDEX one; INSERT INTO t VALUES ('x', 1)")
    assert rows(db.query("SELECT a, live, count(*) FROM t GROUP BY a, live")) == [("X", 1, 1), ("x", 0, 2), ("x", 1, 1), ("y", 1, 1)]
    with pytest.raises(ConstraintError, match="UNIQUE"):
        db.execute("CREATE UNIQUE INDEX two ON t(a)")
    db.execute("INSERT INTO t VALUES ('x', 1)")


def test_renames_reach_all_that_names_them(db):
    db.execute(
        """CREATE TABLE t (k INTEGER PRIMARY KEY, v INTEGER CHECK (v > 0), w INTEGER AS (v + 1) STORED); CREATE TABLE seen (x INTEGER); CREATE UNIQUE INDEX tv ON t(v);
        CREATE TRIGGER s AFTER INSERT ON t WHEN NEW.v > 5 BEGIN INSERT INTO seen VALUES (NEW.v); END; CREATE VIEW big AS SELECT v FROM t WHERE v > 1;
        ALTER TABLE t RENAME COLUMN v TO amount; ALTER TABLE t RENAME TO things; INSERT INTO things(amount) VALUES (1), (7)"""
    )
    assert rows(db.query("SELECT amount, w FROM things")) == [(1, 2), (7, 8)] and rows(db.query("SELECT * FROM seen")) == [(7,)] and rows(db.query("SELECT * FROM big")) == [(7,)]
    for bad in ("INSERT INTO things(amount) VALUES (0)", "INSERT INTO things(amount) VALUES (7)"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    assert "amount" in db.state["tables"]["things"]["sql"] and db.state["triggers"]["s"]["table"] == "things"


def test_collation_of_a_column(db):
    db.execute("CREATE TABLE t (name TEXT COLLATE NOCASE UNIQUE, n INTEGER); INSERT INTO t VALUES ('Ada', 1), ('bob', 2)")
    assert rows(db.query("SELECT n FROM t WHERE name = 'ADA'")) == [(1,)]
    with pytest.raises(ConstraintError, match="UNIQUE"):
        db.execute("INSERT INTO t VALUES ('BOB', 3)")
    assert [r[0] for r in db.query("SELECT name FROM t ORDER BY name DESC").collect()] == ["bob", "Ada"]


def test_update_or_and_insert_or(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT NOT NULL); INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'); UPDATE OR IGNORE t SET id = 3 WHERE id < 3; UPDATE OR IGNORE t SET id = 4 WHERE id > 2")
    assert rows(db.query("SELECT id, v FROM t")) == [(1, "a"), (2, "b"), (4, "c")]
    # All rows change at once: nobody stands in the way of one that leaves.
    db.execute("UPDATE OR IGNORE t SET id = id + 1; UPDATE t SET id = id - 1")
    assert rows(db.query("SELECT id, v FROM t")) == [(1, "a"), (2, "b"), (4, "c")]
    db.execute("UPDATE OR REPLACE t SET id = 4 WHERE v = 'a'; UPDATE OR IGNORE t SET v = NULL WHERE id = 2")
    assert rows(db.query("SELECT id, v FROM t")) == [(2, "b"), (4, "a")]
    with pytest.raises(ConstraintError):
        db.execute("INSERT OR FAIL INTO t VALUES (7, 'g'), (8, 'h'), (2, 'x'), (9, 'i')")
    assert rows(db.query("SELECT id FROM t")) == [(2,), (4,), (7,), (8,)]
    db.execute("BEGIN; DELETE FROM t WHERE id = 7")
    with pytest.raises(ConstraintError):
        db.execute("INSERT OR ROLLBACK INTO t VALUES (2, 'x')")
    assert not db.in_transaction and rows(db.query("SELECT count(*) FROM t")) == [(4,)]
    with pytest.raises(DialectError, match="FAIL"):
        db.execute("UPDATE OR FAIL t SET id = 1")


def test_counters_pragmas_and_explain(spark, db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT); INSERT INTO t(v) VALUES ('a'), ('b'); DELETE FROM t WHERE id = 1; PRAGMA user_version = 42")
    assert rows(db.query("SELECT changes(), total_changes(), last_insert_rowid()")) == [(1, 3, 2)]
    assert rows(Engine(spark).open(db.store.root).execute("PRAGMA user_version")) == [(42,)]
    assert "Scan parquet" in db.execute("EXPLAIN QUERY PLAN SELECT v FROM t").first()[0]
    assert rows(db.execute("SELECT v FROM t WHERE id = :id", {"id": 2})) == [("b",)] and rows(db.execute("SELECT v FROM t WHERE id = ?", [2])) == [("b",)]
    assert db.health()["ok"] and db.health()["generation"] == db.generation
    assert rows(db.query("SELECT name, sum(ncell) FROM dbstat GROUP BY name")) == [("t", 1)]


def test_strays_go_when_they_are_old(db):
    db.execute("CREATE TABLE t (x INTEGER PRIMARY KEY); INSERT INTO t VALUES (1), (2); UPDATE t SET x = 3 WHERE x = 1")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t VALUES (2)")
    assert db.store.list("staged/")
    db.collect_garbage(keep=1)
    assert db.store.list("staged/")
    db.log.sweep(1, 0.0, strays=-1.0)
    assert not db.store.list("staged/") and rows(db.query("SELECT x FROM t")) == [(2,), (3,)]


def test_stores_that_cannot_order_writers(spark, tmp_path):
    store = ArrowStore(f"file://{tmp_path}/arrow")
    with pytest.raises(Unordered):
        store.create("commits/1.json", b"x")
    assert ArrowStore(f"file://{tmp_path}/arrow", single_writer=True).create("commits/1.json", b"x")
    assert store.get("commits/1.json") == b"x" and [k for k, _ in store.modified("commits/")] == ["commits/1.json"]


def test_a_database_behind_sparks_own_file_systems(spark, tmp_path):
    """viewfs is opened by Spark's connectors only, as object stores are."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shop.link./db", f"file://{tmp_path}")
    db = Engine(spark).open("viewfs://shop/db/one")
    assert isinstance(db.store, HadoopStore) and all(db.store.probe().values())
    db.execute("CREATE TABLE t (x INTEGER, v TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b'); UPDATE t SET v = 'z' WHERE x = 2")
    other = Engine(spark).open("viewfs://shop/db/one", mode="fresh", read_only=True)
    db.execute("DELETE FROM t WHERE x = 1")
    assert rows(other.execute("SELECT * FROM t")) == [(2, "z")]
    told = next(iter(db.state["tables"]["t"]["files"].values()))
    assert told["rows"] == 1 and told["bytes"] > 0 and told["ranges"]
    assert db.replicate(f"file://{tmp_path}/copy") == db.generation
    assert rows(Engine(spark).open(f"file://{tmp_path}/copy", read_only=True).query("SELECT * FROM t")) == [(2, "z")]
    assert rows(db.query("SELECT x FROM t WHERE x = 2")) == [(2,)]


def test_memory_databases_are_where_all_machines_see_them(spark):
    from tidemark.sources.folders import shared_folder

    assert Engine(spark).open(":memory:").store.root.removeprefix("file://").startswith(shared_folder(spark).removeprefix("file://"))


def test_a_long_chain_is_read_side_by_side(spark, tmp_path):
    class Counted(LocalStore):
        gets = 0

        def get(self, key):
            Counted.gets += key.startswith("commits/")
            return super().get(key)

    db = Engine(spark).open(str(tmp_path / "db"))
    db.execute("CREATE TABLE t (x INTEGER)")
    for k in range(5):
        db.execute(f"INSERT INTO t VALUES ({k})")
    first = Database(spark, "", store=Counted(str(tmp_path / "db")), read_only=True)
    Counted.gets = 0
    again = Database(spark, "", store=Counted(str(tmp_path / "db")), read_only=True)
    # The state is remembered: only whether a newer commit is there is asked.
    assert again.state == first.state and Counted.gets == 1


def test_writers_take_turns_by_lease(spark, db, monkeypatch):
    from tidemark.sources import lease

    now = [1_000.0]
    monkeypatch.setattr(lease.time, "time", lambda: now[0])
    db.execute("CREATE TABLE t (x INTEGER)")
    one, two = (lease.Lease(db.store, owner, ttl=30, skew=5) for owner in ("one", "two"))
    first = Database(spark, db.store.root, lease=one.claim())
    first.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(lease.LeaseHeld):
        two.claim()
    now[0] += 27
    assert not one.live()
    first.execute("INSERT INTO t VALUES (2)")  # renewed on the way
    assert one.live()
    now[0] += 36
    second = Database(spark, db.store.root, lease=two.claim())
    with pytest.raises(lease.LeaseLost):
        first.execute("INSERT INTO t VALUES (3)")
    second.execute("INSERT INTO t VALUES (4)")
    two.release()
    one.claim()
    assert one.live() and len(db.store.list("leases/")) == 1
    assert rows(Engine(spark).open(db.store.root).query("SELECT x FROM t")) == [(1,), (2,), (4,)]


def test_objects_in_pieces(tmp_path):
    for store in (LocalStore(str(tmp_path / "a")), ArrowStore(f"file://{tmp_path}/b", single_writer=True)):
        store.put_stream("x/y", (bytes([k]) * 3 for k in range(65, 70)))
        assert store.get("x/y") == b"AAABBBCCCDDDEEE" and store.list("x/") == ["x/y"]

        def broken():
            yield b"half"
            raise OSError("gone")

        with pytest.raises(OSError):
            store.put_stream("x/z", broken())
        assert store.get("x/z") is None


def test_boxes_and_texts_as_tables(db):
    db.execute("CREATE VIRTUAL TABLE b USING rtree(id, x0, x1, +note); INSERT INTO b VALUES (1, 0, 2, 'low'), (2, 5.5, 9, 'high')")
    assert rows(db.query("SELECT id, note FROM b WHERE x1 >= 1.5 AND x0 <= 3")) == [(1, "low")]
    for bad in ("INSERT INTO b VALUES (3, 4, 1, '')", "INSERT INTO b VALUES (1, 0, 1, '')"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    db.execute("CREATE VIRTUAL TABLE IF NOT EXISTS f USING fts5(title, body UNINDEXED, prefix = '2 3'); INSERT INTO f VALUES ('Grey Heron', 'stands'), ('Night heron', NULL), ('Stork', 'a heron?')")
    assert rows(db.query("SELECT rowid FROM f WHERE title MATCH 'heron NOT night'")) == [(1,)]
    assert rows(db.query("SELECT rowid FROM f WHERE f MATCH 'heron'")) == [(1,), (2,), (3,)]
    with pytest.raises(DialectError, match="module"):
        db.execute("CREATE VIRTUAL TABLE g USING geo(x)")
    db.execute("DROP TABLE b")
    assert db.tables() == ["f"]
