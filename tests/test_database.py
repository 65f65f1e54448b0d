import pytest

from tidemark.database import ConstraintError, Database, ReadOnly
from tidemark.plans.script import DialectError
from tidemark.session import Engine
from tidemark.sources import log
from tidemark.sources.log import CorruptLog, WriteConflict
from tidemark.sources.store import LocalStore, StoreError


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def db(spark, tmp_path):
    made = Engine(spark).open(str(tmp_path / "db"))
    made.execute("CREATE TABLE items (id INTEGER PRIMARY KEY, v TEXT NOT NULL); INSERT INTO items(v) VALUES ('one'), ('two'), ('three')")
    return made


def test_snapshot_and_fresh(spark, db):
    snapshot, fresh = (Engine(spark).open(db.store.root, mode=m, read_only=True) for m in ("snapshot", "fresh"))
    db.execute("INSERT INTO items VALUES (4, 'four')")
    assert len(rows(snapshot.execute("SELECT * FROM items"))) == 3
    assert len(rows(fresh.execute("SELECT * FROM items"))) == 4
    assert snapshot.refresh() == db.generation
    assert len(rows(snapshot.execute("SELECT * FROM items"))) == 4
    with pytest.raises(ReadOnly):
        snapshot.execute("DELETE FROM items")


def test_writers_that_do_not_overlap_both_commit(spark, db):
    other = Engine(spark).open(db.store.root)
    db.execute("CREATE TABLE other (x INTEGER)")
    other.execute("UPDATE items SET v = 'changed' WHERE id = 1")
    assert other.generation == db.generation + 1
    db.refresh()
    assert rows(db.query("SELECT v FROM items WHERE id = 1")) == [("changed",)]


def test_writers_that_overlap_conflict(spark, db):
    other = Engine(spark).open(db.store.root)
    db.execute("UPDATE items SET v = 'mine' WHERE id = 1")
    with pytest.raises(WriteConflict):
        other.execute("UPDATE items SET v = 'theirs' WHERE id = 2")
    other.refresh()
    other.execute("UPDATE items SET v = 'theirs' WHERE id = 2")
    assert rows(other.query("SELECT v FROM items")) == [("mine",), ("theirs",), ("three",)]


def test_constraints_leave_nothing_behind(db):
    before = db.generation
    for bad, why in (("INSERT INTO items VALUES (1, 'again')", "UNIQUE"), ("INSERT INTO items(v) VALUES (NULL)", "NOT NULL"), ("UPDATE items SET id = 1", "UNIQUE")):
        with pytest.raises(ConstraintError, match=why):
            db.execute(bad)
    db.execute("CREATE TABLE c (x INTEGER CHECK (x > 0))")
    with pytest.raises(ConstraintError, match="CHECK"):
        db.execute("INSERT INTO c VALUES (-1)")
    assert db.generation == before + 1 and len(rows(db.query("SELECT * FROM items"))) == 3


def test_foreign_keys_when_on(db):
    db.execute("CREATE TABLE child (item INTEGER REFERENCES items(id)); INSERT INTO child VALUES (77); PRAGMA foreign_keys = ON")
    with pytest.raises(ConstraintError, match="FOREIGN KEY"):
        db.execute("INSERT INTO child VALUES (78)")
    db.execute("INSERT INTO child VALUES (2)")


def test_guards(db):
    for text in ("ATTACH 'x' AS y", "PRAGMA journal_mode = delete", "PRAGMA synchronous(0)"):
        with pytest.raises(DialectError, match="not authorized"):
            db.execute(text)
    assert rows(db.execute("PRAGMA journal_mode")) == [("wal",)]


def test_history_survives_checkpoints_and_damage(spark, db):
    db.checkpoint()
    db.execute("DELETE FROM items WHERE id = 2")
    again = Engine(spark).open(db.store.root)
    assert rows(again.query("SELECT id FROM items")) == [(1,), (3,)]
    assert rows(again.at(db.generation - 1).sql("SELECT id FROM items")) == [(1,), (2,), (3,)]
    for key in db.store.list("checkpoints/"):
        db.store.put(key, b"broken")
    assert rows(Engine(spark).open(db.store.root).query("SELECT id FROM items")) == [(1,), (3,)]
    db.store.put("commits/000000000002.json", b"{}")
    with pytest.raises((CorruptLog, KeyError)):
        Engine(spark).open(db.store.root)


def test_sweep_keeps_what_is_live(spark, db):
    for k in range(3):
        db.execute(f"UPDATE items SET v = 'v{k}'")
    gone = db.collect_garbage(keep=1)
    assert gone and rows(db.query("SELECT DISTINCT v FROM items")) == [("v2",)]
    copy = db.store.path + "-copy"
    assert db.replicate(copy) == db.generation
    assert rows(Engine(spark).open(copy, read_only=True).query("SELECT DISTINCT v FROM items")) == [("v2",)]


class Faulty(LocalStore):
    """Fails after (or before) the next create of a commit."""

    fail = None

    def create(self, key, data):
        if key.startswith("commits/") and self.fail:
            how, self.fail = self.fail, None
            if how == "after":
                super().create(key, data)
            raise StoreError("the connection is gone")
        return super().create(key, data)


class Down(LocalStore):
    """Takes no commit while it is down."""

    down = False

    def create(self, key, data):
        if key.startswith("commits/") and self.down:
            raise StoreError("the connection is gone")
        return super().create(key, data)


@pytest.mark.parametrize("how", ["before", "after"])
def test_lost_answers(spark, tmp_path, how):
    """A publish whose answer is lost takes place once, whether or not the first attempt arrived."""
    store = Faulty(str(tmp_path / "db"))
    db = Database(spark, "", store=store)
    db.execute("CREATE TABLE t (x INTEGER)")
    store.fail = how
    db.execute("INSERT INTO t VALUES (1)")
    assert rows(db.query("SELECT x FROM t")) == [(1,)]
    db.execute("INSERT INTO t VALUES (2)")
    assert log.Log(store).load()["generation"] == db.generation == 3


def test_a_store_that_stays_down(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log.Log.publish, "__defaults__", (60, 0.3))
    store = Down(str(tmp_path / "db"))
    db = Database(spark, "", store=store)
    db.execute("CREATE TABLE t (x INTEGER)")
    store.down = True
    with pytest.raises(StoreError):
        db.execute("INSERT INTO t VALUES (1)")
    store.down = False
    assert rows(db.query("SELECT count(*) FROM t")) == [(0,)]
    db.execute("INSERT INTO t VALUES (2)")
    assert rows(db.query("SELECT x FROM t")) == [(2,)]


def test_store_probe(tmp_path):
    assert all(LocalStore(str(tmp_path)).probe().values())


def test_triggers_run_for_all_changed_rows(db):
    db.execute("CREATE TABLE log (what TEXT, id INTEGER, was TEXT, now TEXT)")
    db.execute(
        "CREATE TRIGGER a AFTER INSERT ON items BEGIN INSERT INTO log VALUES ('insert', NEW.id, NULL, NEW.v); END;"
        "CREATE TRIGGER b AFTER UPDATE OF v ON items FOR EACH ROW WHEN NEW.v <> OLD.v BEGIN INSERT INTO log SELECT 'update', NEW.id, OLD.v, NEW.v WHERE NEW.id > 1; END;"
        "CREATE TRIGGER c AFTER DELETE ON items BEGIN INSERT INTO log(what, id) VALUES ('delete', OLD.id); END"
    )
    db.execute("INSERT INTO items(v) VALUES ('four'); UPDATE items SET v = 'x' WHERE id <= 2; UPDATE items SET v = v; DELETE FROM items WHERE id = 3")
    assert rows(db.query("SELECT what, id, coalesce(was, '-'), coalesce(now, '-') FROM log")) == [("delete", 3, "-", "-"), ("insert", 4, "-", "four"), ("update", 2, "two", "x")]
    with pytest.raises(DialectError):
        db.execute("CREATE TRIGGER d INSTEAD OF INSERT ON items BEGIN INSERT INTO log(what) VALUES ('x'); END")


def test_triggers_before_and_on_views(db):
    db.execute(
        """CREATE TABLE totals (name TEXT, n INTEGER); INSERT INTO totals VALUES ('in', 0), ('out', 0); CREATE TABLE bin (id INTEGER, v TEXT); INSERT INTO bin VALUES (2, 'old');
        CREATE TRIGGER no BEFORE INSERT ON items WHEN NEW.v = 'bad' BEGIN SELECT RAISE(ABORT, 'no bad items'); END;
        CREATE TRIGGER few BEFORE DELETE ON items BEGIN SELECT CASE WHEN OLD.v = 'one' THEN RAISE(ABORT, 'the first stays') END; DELETE FROM bin WHERE id = OLD.id; INSERT INTO bin VALUES (OLD.id, OLD.v); END;
        CREATE TRIGGER up BEFORE UPDATE OF v ON items WHEN length(NEW.v) < 2 BEGIN SELECT RAISE(ROLLBACK, 'too short'); END;
        CREATE TRIGGER add1 AFTER INSERT ON items BEGIN UPDATE totals SET n = NEW.id WHERE name = 'in'; END"""
    )
    for bad, why in (("INSERT INTO items(v) VALUES ('good'), ('bad')", "no bad items"), ("DELETE FROM items", "the first stays"), ("UPDATE items SET v = 'x' WHERE id = 3", "too short")):
        with pytest.raises(ConstraintError, match=why):
            db.execute(bad)
    db.execute("INSERT INTO items(v) VALUES ('four'); DELETE FROM items WHERE id = 2")
    assert rows(db.query("SELECT * FROM bin")) == [(2, "two")] and rows(db.query("SELECT * FROM totals")) == [("in", 4), ("out", 0)]
    db.execute(
        """CREATE VIEW shown AS SELECT id, upper(v) AS name FROM items;
        CREATE TRIGGER vi INSTEAD OF INSERT ON shown BEGIN INSERT INTO items(id, v) VALUES (NEW.id, lower(NEW.name)); END;
        CREATE TRIGGER vu INSTEAD OF UPDATE ON shown BEGIN UPDATE items SET v = lower(NEW.name) WHERE id = OLD.id; END;
        CREATE TRIGGER vd INSTEAD OF DELETE ON shown BEGIN DELETE FROM items WHERE id = OLD.id; END;
        INSERT INTO shown VALUES (7, 'SEVEN'), (8, 'EIGHT'); UPDATE shown SET name = name || '!' WHERE id >= 7; DELETE FROM shown WHERE name = 'EIGHT!'"""
    )
    assert rows(db.query("SELECT id, v FROM items")) == [(1, "one"), (3, "three"), (4, "four"), (7, "seven!")]
    with pytest.raises(DialectError, match="view"):
        db.execute("CREATE VIEW plain AS SELECT 1 AS x; DELETE FROM plain")
