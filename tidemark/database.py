"""A versioned database: immutable Parquet files, one commit log for all tables.

Rows carry a `_rowid`. Updates and deletes rewrite only the files that hold a row
to change; Spark finds and rewrites them. A statement outside a transaction is one
commit; BEGIN holds all until COMMIT. `snapshot` sessions stay at the generation
they were opened at; `fresh` ones look for a newer one before each statement
outside a transaction.
"""

from __future__ import annotations

import copy
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.core import truth
from tidemark.plans import dialect, prune, script
from tidemark.plans.dialect import DialectError, Parser, Scope, name_sql
from tidemark.session import Session, column_types, run_query
from tidemark.sources.folders import shared_folder
from tidemark.sources.lease import Lease
from tidemark.sources.log import Log, difference
from tidemark.sources.store import Store, open_store

SPARK = {"int": T.LongType(), "real": T.DoubleType(), "numeric": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType()}
#: Footers of up to so many new files are read by the driver, of more by the executors; what is recorded is the same.
MOST_FOOTERS = 256
#: VACUUM writes files of about so many bytes.
VACUUM_BYTES = 128 << 20
#: What compares two columns by which collation.
COLLATIONS = {"NOCASE": "UTF8_LCASE", "RTRIM": "UTF8_BINARY_RTRIM"}


def file_facts(uri: str) -> dict:
    """Rows, bytes and column ranges of a Parquet file, from its footer."""
    files, path = pafs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as f:
        meta = pq.read_metadata(f)
    ranges: dict[str, list] = {}
    unknown = set()
    for g in range(meta.num_row_groups):
        for i in range(meta.num_columns):
            column = meta.row_group(g).column(i)
            s = column.statistics
            if s is not None and s.has_min_max and isinstance(s.min, (int, float, str)):
                lo, hi = ranges.get(column.path_in_schema, [s.min, s.max])
                ranges[column.path_in_schema] = [min(lo, s.min), max(hi, s.max)]
            elif s is None or s.null_count is None or s.null_count < column.num_values:
                unknown.add(column.path_in_schema)
    return {"rows": meta.num_rows, "bytes": sum(meta.row_group(g).total_byte_size for g in range(meta.num_row_groups)), "ranges": {c: r for c, r in ranges.items() if c not in unknown}}


class ConstraintError(ValueError):
    """Rows that a table does not take."""


class RolledBack(ConstraintError):
    """A failed row of OR ROLLBACK: the transaction is over."""


class PartlyDone(ConstraintError):
    """A failed row of OR FAIL: the rows before it stay."""


class ReadOnly(RuntimeError):
    pass


class Database:
    def __init__(self, spark: SparkSession, root: str, mode: str = "snapshot", read_only: bool = False, store: Store | None = None, single_writer: bool = False, lease: Lease | None = None):
        if mode not in ("snapshot", "fresh"):
            raise ValueError(f"unknown consistency mode {mode!r}")
        if root == ":memory:":
            root = f"{shared_folder(spark)}/tidemark-memory-{uuid.uuid4().hex}"
        self.spark, self.mode, self.read_only = spark, mode, read_only
        self.store = store or open_store(root, single_writer, spark)
        self.log = Log(self.store)
        self.base = self.log.load()
        self.state = copy.deepcopy(self.base)
        #: Where writers take turns; without one, whoever commits first goes first.
        self.lease = lease
        self.in_transaction = False
        self.savepoints: list[tuple[str, dict]] = []
        self.foreign_keys = False
        self.changed, self.total_changed, self.last_rowid = 0, 0, 0
        self.last_table: str | None = None
        self.whole: set[str] = set()
        self.firing = 0

    # Reading.

    def refresh(self) -> int:
        """Moves to the newest commit; returns its generation."""
        if not self.in_transaction:
            self.base = self.log.follow(self.base)
            self.state = copy.deepcopy(self.base)
        return self.base["generation"]

    @property
    def generation(self) -> int:
        return self.base["generation"]

    def _schema(self, t: dict) -> T.StructType:
        return T.StructType([T.StructField("_rowid", T.LongType()), *[T.StructField(c["id"], SPARK[c["type"]]) for c in t["columns"]]])

    def _scan(self, t: dict, files: list[str], located: bool) -> DataFrame:
        """The rows of some files under the table's column names, with `_file` where `located`.

        Files that were renumbered when they were committed have their row ids counted up here.
        """
        schema = self._schema(t)
        moved = {f: t["files"][f]["shift"] for f in files if "shift" in t["files"].get(f, {})}
        plain = [f for f in files if f not in moved]

        def read(some: list[str]) -> DataFrame:
            df = self.spark.read.schema(schema).parquet(*[self.store.uri(f) for f in some])
            return df.withColumn("_file", F.input_file_name()) if located or moved else df

        df = read(plain) if plain else self.spark.createDataFrame([], schema).withColumn("_file", F.lit(""))
        if moved:
            # One row for each renumbered file that is live.
            shifts = self.spark.createDataFrame([(f.rpartition("/")[2], *by) for f, by in moved.items()], "_name string, _from long, _by long")
            own = read(sorted(moved)).join(F.broadcast(shifts), F.element_at(F.split("_file", "/"), -1) == F.col("_name"))
            own = own.withColumn("_rowid", F.when(F.col("_rowid") >= F.col("_from"), F.col("_rowid") + F.col("_by")).otherwise(F.col("_rowid"))).drop("_name", "_from", "_by")
            df = df.unionByName(own) if plain else own
        collated = lambda c: F.collate(F.col(c["id"]), COLLATIONS[c["collate"]]) if c.get("collate") in COLLATIONS and c["type"] == "text" else F.col(c["id"])
        return df.select("_rowid", *[collated(c).alias(c["name"]) for c in t["columns"]], *["_file"] * located)

    def _read(self, t: dict, files: list[str] | None = None) -> DataFrame:
        """The rows of some files (all live ones unless told)."""
        return self._scan(t, sorted(t["files"]) if files is None else files, False)

    def table(self, name: str) -> DataFrame:
        t = self._table(name)
        return self._read(t)

    def _table(self, name: str) -> dict:
        for n, t in self.state["tables"].items():
            if n.lower() == name.lower():
                return t
        raise DialectError(f"no such table: {name}")

    def _name(self, name: str) -> str:
        return next((n for n in self.state["tables"] if n.lower() == name.lower()), name)

    def _pruned(self, text: str) -> dict[str, list[str]]:
        """The files that a statement can need of the one table it reads, by the ranges in the manifest."""
        found = prune.conditions(text)
        t = self.state["tables"].get(self._name(found[0])) if found and found[1] else None
        return {} if t is None else {self._name(found[0]): prune.files(t, found[1])}

    def _tables(self, state: dict | None = None, text: str | None = None) -> dict[str, DataFrame]:
        """Tables and views by name; with `text` only those that it names, and only the files that it can need."""
        state = state or self.state
        seen, told = set(), (text or "").lower()
        while True:
            more = {n for n in [*state["tables"], *state["views"]] if text is None or n.lower() in told} - seen
            if not more:
                break
            seen |= more
            told += " ".join(state["views"][n].lower() for n in more if n in state["views"])
        files = self._pruned(text) if text is not None and state is self.state else {}
        rowid = "rowid" in told
        out = {n: self._read(t, files.get(n)) for n, t in state["tables"].items() if n in seen}
        out = {n: df if rowid or "_rowid" in [c["name"] for c in state["tables"][n]["columns"]] else df.drop("_rowid") for n, df in out.items()}
        if text is None or "sqlite_" in told:
            out["sqlite_schema"] = out["sqlite_master"] = self.catalog(state)
        if text is None or "dbstat" in told:
            out["dbstat"] = self.file_statistics(state)
        for n, body in state["views"].items():
            if n in seen:
                out[n] = run_query(self.spark, body, out)
        return out

    def query(self, text: str, args: dict | list | None = None) -> DataFrame:
        return run_query(self.spark, text, self._tables(text=text), args, self.counters())

    def counters(self) -> dict[str, int]:
        """What changes(), total_changes() and last_insert_rowid() are at this moment."""
        return {"changes": self.changed, "total_changes": self.total_changed, "last_insert_rowid": self.last_rowid}

    def file_statistics(self, state: dict | None = None) -> DataFrame:
        """The `dbstat` table: a row for each live file, told by the manifest alone."""
        rows = [(n, f, i + 1, "leaf", told["rows"], told["bytes"]) for n, t in sorted((state or self.state)["tables"].items()) for i, (f, told) in enumerate(sorted(t["files"].items()))]
        return self.spark.createDataFrame(rows, "name string, path string, pageno long, pagetype string, ncell long, pgsize long")

    def at(self, generation: int) -> Session:
        """The tables as they were at an earlier generation."""
        return Session(self.spark, self._tables(self.log.load(generation)))

    def changes(self, first: int, last: int | None = None, table: str | None = None) -> DataFrame:
        """Rows that came and went between two generations, with `_change` of insert or delete."""
        old, new = self.log.load(first), self.log.load(last)
        name = self._name(table)
        a, b = old["tables"].get(name), new["tables"].get(name)
        head = b or a
        before, after = set((a or {}).get("files", {})), set((b or {}).get("files", {}))
        # Each side's files as its own state has them: renumbered files tell so there.
        gone = self._read(head | {"files": (a or {}).get("files", {})}, sorted(before - after))
        came = self._read(head | {"files": (b or {}).get("files", {})}, sorted(after - before))
        # Files that were rewritten hold rows that did not change: these cancel.
        return came.exceptAll(gone).withColumn("_change", F.lit("insert")).unionByName(gone.exceptAll(came).withColumn("_change", F.lit("delete")))

    def catalog(self, state: dict | None = None) -> DataFrame:
        state = state or self.state
        rows = [("table", n, n, i + 2, t["sql"]) for i, (n, t) in enumerate(sorted(state["tables"].items()))]
        rows += [("view", n, n, 0, f"CREATE VIEW {n} AS {text}") for n, text in sorted(state["views"].items())]
        rows += [("index", n, x["table"], 0, x["sql"]) for n, x in sorted(state["indexes"].items())]
        rows += [("trigger", n, x["table"], 0, x["sql"]) for n, x in sorted(state["triggers"].items())]
        return self.spark.createDataFrame(rows, "type string, name string, tbl_name string, rootpage long, sql string")

    def tables(self) -> list[str]:
        return sorted([*self.state["tables"], *self.state["views"]])

    def status(self) -> dict:
        files = [f for t in self.state["tables"].values() for f in t["files"].values()]
        return {"root": self.store.root, "generation": self.generation, "mode": self.mode, "in_transaction": self.in_transaction, "tables": len(self.state["tables"]), "files": len(files), "rows": sum(f["rows"] for f in files), "bytes": sum(f["bytes"] for f in files)}

    def health(self) -> dict:
        try:
            return {"ok": True, "generation": self.log.follow(self.base)["generation"], "role": "reader" if self.read_only else "writer", "store": self.store.probe()}
        except Exception as e:
            return {"ok": False, "error": str(e)}

    # Statements.

    def execute(self, text: str, args: dict | list | None = None) -> DataFrame | None:
        """Runs a script; stops at the first error. Returns the last statement's rows, if it has any."""
        out = None
        for s in script.statements(text):
            out = self.statement(s, args)
        return out

    sql = execute

    def statement(self, text: str, args: dict | list | None = None) -> DataFrame | None:
        script.guard(text)
        kind = script.kind(text)
        if self.mode == "fresh":
            self.refresh()
        if kind == "query":
            return self.query(text, args)
        if kind == "explain":
            body = script.tokens(text)
            skip = 4 if body[1].is_("QUERY") and body[2].is_("PLAN") else 1
            start = body[3 if skip == 4 else 1].start
            plan = self.query(text[start:])._jdf.queryExecution().toString()
            return self.spark.createDataFrame([(plan,)], "plan string")
        if kind == "pragma":
            return self._pragma(text)
        if self.read_only and kind != "tcl":
            raise ReadOnly("attempt to write a readonly database")
        if kind == "tcl":
            return self._transaction(text)
        held = copy.deepcopy(self.state)
        try:
            out = {"dml": self._dml, "ddl": self._ddl, "vacuum": lambda _: self.vacuum()}[kind](text)
        except RolledBack:
            self.in_transaction, self.savepoints = False, []
            self.state = copy.deepcopy(self.base)
            raise
        except PartlyDone:
            # What came before the row that failed stays.
            if not self.in_transaction:
                self._publish()
            raise
        except Exception:
            self.state = held
            raise
        if not self.in_transaction:
            self._publish()
        return out

    def _publish(self) -> None:
        change = difference(self.base, self.state)
        if not change["tables"] and len(change) == 1:
            return
        for n in self.whole & change["tables"].keys():
            change["tables"][n]["whole"] = True
        old = {n: t["next_rowid"] for n, t in self.base["tables"].items()}
        try:
            if self.lease is not None:
                self.lease.fence()
            self.base = self.log.publish(self.base, change)
            if self.last_table in old and self.last_table in self.base["tables"]:
                # What others gave out in between came first.
                mine = self.state["tables"][self.last_table]["next_rowid"]
                self.last_rowid += max(0, self.base["tables"][self.last_table]["next_rowid"] - mine) if self.last_rowid >= old[self.last_table] else 0
            self.last_table = None
        finally:
            self.state = copy.deepcopy(self.base)
            self.whole = set()

    def _transaction(self, text: str) -> None:
        words = [t.value.upper() for t in script.tokens(text)]
        if words[0] == "BEGIN":
            if self.in_transaction:
                raise DialectError("cannot start a transaction within a transaction")
            self.in_transaction = True
        elif words[0] in ("COMMIT", "END"):
            if not self.in_transaction:
                raise DialectError("cannot commit - no transaction is active")
            self.in_transaction, self.savepoints = False, []
            self._publish()
        elif words[0] == "SAVEPOINT":
            self.savepoints.append((words[1], copy.deepcopy(self.state)))
            self.in_transaction = True
        elif "TO" in words or words[0] == "RELEASE":
            at = next((i for i in range(len(self.savepoints) - 1, -1, -1) if self.savepoints[i][0] == words[-1]), None)
            if at is None:
                raise DialectError(f"no such savepoint: {words[-1]}")
            if words[0] == "ROLLBACK":
                self.state = copy.deepcopy(self.savepoints[at][1])
                del self.savepoints[at + 1 :]
            else:
                del self.savepoints[at:]
                if not self.savepoints and not any(w == "BEGIN" for w in words):
                    self.in_transaction = False
                    self._publish()
        else:
            self.in_transaction, self.savepoints = False, []
            self.state = copy.deepcopy(self.base)

    # Writing.

    def _write(self, t: dict, rows: DataFrame) -> int:
        """Writes rows (with _rowid) as new files of a table; returns how many."""
        folder = f"data/{t['id']}/{uuid.uuid4().hex}"
        physical = rows.select(F.col("_rowid").cast("long"), *[F.col(name_sql(c["name"])).cast(SPARK[c["type"]]).alias(c["id"]) for c in t["columns"]])
        physical.write.parquet(self.store.uri(folder))
        files = [f for f in self.store.list(folder + "/") if f.endswith(".parquet")]
        total = 0
        for f, told in zip(files, self._facts(files, t), strict=True):
            if told["rows"]:
                t["files"][f] = told
                total += told["rows"]
            else:
                self.store.delete(f)
        return total

    def _facts(self, files: list[str], t: dict) -> list[dict]:
        """Rows, bytes and column ranges of new files; the same whoever reads them."""
        uris = [self.store.uri(f) for f in files]
        if not self.store.root.startswith("file:"):
            return self._queried_facts(files, t)
        if len(files) <= MOST_FOOTERS:
            with ThreadPoolExecutor(8) as pool:
                return list(pool.map(file_facts, uris))
        from tidemark.shipping import ship_package

        ship_package(self.spark)
        return self.spark.sparkContext.parallelize(uris, max(1, len(uris) // 16)).map(file_facts).collect()

    def _queried_facts(self, files: list[str], t: dict) -> list[dict]:
        """The same where only Spark opens the files: one aggregation by file over whole columns."""
        if not files:
            return []
        ids = ["_rowid", *[c["id"] for c in t["columns"] if c["type"] in ("int", "real", "numeric", "text")]]
        df = self.spark.read.schema(self._schema(t)).parquet(*[self.store.uri(f) for f in files])
        made = df.groupBy(F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_size").alias("_s")).agg(F.count("*").alias("_n"), *[e for c in ids for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
        found = {r["_f"]: r for r in made.collect()}
        out = []
        for f in files:
            r = found.get(f.rpartition("/")[2])
            out.append({"rows": 0, "bytes": 0} if r is None else {"rows": r["_n"], "bytes": r["_s"], "ranges": {c: [r[f"lo_{c}"], r[f"hi_{c}"]] for c in ids if r[f"lo_{c}"] is not None}})
        return out

    def _numbered(self, t: dict, rows: DataFrame, exact: bool) -> DataFrame:
        """Row ids from the table's next one on. Few rows count up by one; many get ids that grow but may skip."""
        key = next((c["name"] for c in t["columns"] if c.get("rowid")), None)
        order = F.monotonically_increasing_id()
        if exact:
            from pyspark.sql import Window

            order = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1
        made = rows.withColumn("_rowid", (order + F.lit(t["next_rowid"])).cast("long"))
        if key is not None:
            made = made.withColumn("_rowid", F.coalesce(F.col(name_sql(key)).cast("long"), F.col("_rowid"))).withColumn(key, F.col("_rowid"))
        return made

    def import_table(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """A new table from a DataFrame, in one commit of its own unless a transaction is open."""
        kinds = {"int": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB", "bool": "INTEGER", "ts": "TEXT"}
        types = column_types(df)
        columns = [f"{name_sql(c).replace('`', chr(34))} {kinds.get(types[c], 'TEXT')}{' PRIMARY KEY' if c == key else ''}" for c in df.columns]
        self._require_writable()
        held = copy.deepcopy(self.state)
        try:
            self._ddl(f"CREATE TABLE {name} ({', '.join(columns)})")
            rows = df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if types[c] == "ts" else F.col(c) for c in df.columns])
            self._insert_rows(self._table(name), name, rows, exact=False, check=key is not None)
        except Exception:
            self.state = held
            raise
        if not self.in_transaction:
            self._publish()

    def _require_writable(self) -> None:
        if self.read_only:
            raise ReadOnly("attempt to write a readonly database")

    # Rows.

    def _expr(self, t: dict, name: str, text: str, condition: bool = False) -> F.Column:
        p = Parser(text, lambda n: None)
        v = p.expr(Scope({name: {c["name"]: c["type"] for c in t["columns"]}}))
        # Rows stand alone here, without the table's name.
        return F.expr((truth(v) if condition else v.sql).replace(f"{name_sql(name)}.", ""))

    def _keys(self, t: dict, name: str) -> list[tuple[str, list[F.Column], F.Column | None, list[str] | None]]:
        """What must be unique: how it is told, its values, which rows it holds for, its columns if it has plain ones."""
        out = [(", ".join(f"{name}.{c}" for c in k), [F.col(name_sql(c)) for c in k], None, list(k)) for k in t["keys"]]
        known = {c["name"].lower(): c["name"] for c in t["columns"]}
        for n, x in sorted(self.state["indexes"].items()):
            if x["unique"] and x["table"].lower() == name.lower():
                plain = all(c.lower() in known for c in x["columns"])
                named = [known[c.lower()] for c in x["columns"]] if plain else None
                values = [F.col(name_sql(c)) for c in named] if plain else [self._expr(t, name, c) for c in x["columns"]]
                told = ", ".join(f"{name}.{c}" for c in named) if plain else f"index '{n}'"
                out.append((told, values, self._expr(t, name, x["where"], True) if x["where"] else None, named))
        return out

    def _near(self, t: dict, rows: DataFrame, values: list[F.Column], columns: list[str] | None) -> list[str]:
        """Files whose ranges meet those of the rows' keys; all files where that cannot be told."""
        by_name = {c["name"]: c for c in t["columns"]}
        if columns is None or len(t["files"]) < 2 or any(by_name[c].get("collate") or by_name[c]["type"] == "blob" for c in columns):
            return sorted(t["files"])
        ends = rows.agg(*[e for i, v in enumerate(values) for e in (F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"))]).first()
        if any(ends[f"lo{i}"] is None for i in range(len(values))):
            return []
        return prune.files(t, [x for i, c in enumerate(columns) for x in ((c, ">=", ends[f"lo{i}"]), (c, "<=", ends[f"hi{i}"]))])

    def _broken(self, t: dict, name: str) -> list[tuple[F.Column, str]]:
        """Tests for rows that break NOT NULL or CHECK."""
        tests = [(F.col(name_sql(c["name"])).isNull(), f"NOT NULL constraint failed: {name}.{c['name']}") for c in t["columns"] if c.get("notnull") and not c.get("rowid")]
        return tests + [(~self._expr(t, name, text, True), f"CHECK constraint failed: {text}") for text in t["checks"]]

    def _checked(self, t: dict, name: str, rows: DataFrame, replaced: DataFrame | None = None, keys: bool = True) -> None:
        """Raises for rows that break NOT NULL, CHECK or a key; `replaced` has the row ids that are about to go."""
        tests = self._broken(t, name)
        if tests:
            # One pass for all tests.
            failed = rows.agg(*[F.coalesce(F.max(test.cast("int")), F.lit(0)).alias(f"t{i}") for i, (test, _) in enumerate(tests)]).first()
            for i, (_, message) in enumerate(tests):
                if failed[f"t{i}"]:
                    raise ConstraintError(message)
        if self.foreign_keys:
            for columns, parent, others, *_ in t["references"]:
                p = self._table(parent)
                target = self._read(p).select(*[F.col(name_sql(c)).alias(f"_p{i}") for i, c in enumerate(others or p["keys"][0])])
                real = rows.dropna(subset=columns)
                if parent.lower() == name.lower():
                    target = target.union(rows.select(*(others or p["keys"][0])))
                if not real.join(target, [F.col(name_sql(c)) == F.col(f"_p{i}") for i, c in enumerate(columns)], "left_anti").isEmpty():
                    raise ConstraintError("FOREIGN KEY constraint failed")
        if not keys:
            return
        for told, values, where, columns in self._keys(t, name):
            self.whole.add(self._name(name))
            real = self._keyed(rows, values, where)
            ids = [f"_k{i}" for i in range(len(values))]
            if not real.groupBy(*ids).count().where("count > 1").isEmpty():
                raise ConstraintError(f"UNIQUE constraint failed: {told}")
            if t["files"]:
                there = self._read(t, self._near(t, rows, values, columns))
                if replaced is not None:
                    there = there.join(replaced.select(F.col("_rowid").alias("_gone")), F.col("_rowid") == F.col("_gone"), "left_anti")
                if not self._keyed(there, values, where).join(real.select(*ids), ids, "left_semi").isEmpty():
                    raise ConstraintError(f"UNIQUE constraint failed: {told}")

    def _keyed(self, rows: DataFrame, values: list[F.Column], where: F.Column | None) -> DataFrame:
        """Row ids and key values (_k0, _k1, ...) of the rows that a key holds for: those without a null in it."""
        made = (rows if where is None else rows.where(where)).select("_rowid", *[v.alias(f"_k{i}") for i, v in enumerate(values)])
        return made.dropna(subset=[f"_k{i}" for i in range(len(values))])

    def _completed(self, t: dict, name: str, rows: DataFrame) -> DataFrame:
        """All columns of the table: defaults for those not given, generated ones computed."""
        given = {c.lower(): c for c in rows.columns}
        out = []
        for c in t["columns"]:
            if c["name"].lower() in given:
                out.append(F.col(name_sql(given[c["name"].lower()])).cast(SPARK[c["type"]]).alias(c["name"]))
            elif c.get("default") is not None:
                out.append(F.expr(Parser(c["default"], lambda n: None).expr(Scope()).sql).cast(SPARK[c["type"]]).alias(c["name"]))
            else:
                out.append(F.lit(None).cast(SPARK[c["type"]]).alias(c["name"]))
        made = rows.select(*out)
        made = made.withColumns({c["name"]: F.collate(F.col(name_sql(c["name"])), COLLATIONS[c["collate"]]) for c in t["columns"] if c.get("collate") in COLLATIONS and c["type"] == "text"})
        for c in t["columns"]:
            if c.get("generated"):
                p = Parser(c["generated"], lambda n: None)
                made = made.withColumn(c["name"], F.expr(p.expr(Scope({name: {x["name"]: x["type"] for x in t["columns"]}})).sql).cast(SPARK[c["type"]]))
        return made

    def _insert_rows(self, t: dict, name: str, rows: DataFrame, exact: bool, check: bool = True) -> DataFrame:
        made = self._numbered(t, self._completed(t, name, rows), exact)
        if check:
            self._checked(t, name, made)
        before = set(t["files"])
        n = self._write(t, made)
        fresh = self._read(t, sorted(set(t["files"]) - before))
        self.changed, self.total_changed = n, self.total_changed + n
        if n:
            ranges = [t["files"][f].get("ranges", {}).get("_rowid") for f in set(t["files"]) - before]
            top = max((r[1] for r in ranges if r), default=None)
            self.last_rowid = fresh.agg(F.max("_rowid")).first()[0] if top is None else top
            t["next_rowid"] = max(t["next_rowid"], self.last_rowid + 1)
            self.last_table = self._name(name)
        return fresh

    def _rewritten(self, t: dict, hit: DataFrame, change) -> None:
        """Rewrites the files with rows that `hit` (row ids, with _file) names; `change` maps their rows to new ones."""
        known = {f.rpartition("/")[2]: f for f in t["files"]}
        touched = sorted({known[r["_file"].rpartition("/")[2]] for r in hit.select("_file").distinct().collect()})
        if not touched:
            return
        kept = change(self._read(t, touched))
        old = {f: t["files"].pop(f) for f in touched}
        try:
            self._write(t, kept)
        except Exception:
            t["files"].update(old)
            raise

    def _located(self, t: dict, files: list[str] | None = None) -> DataFrame:
        return self._scan(t, sorted(t["files"]) if files is None else files, True)

    def _dml(self, text: str) -> DataFrame | None:
        tables = self._tables(text=text)
        catalog = lambda n: next((column_types(df) for k, df in tables.items() if k.lower() == n.lower()), None)
        p = Parser(text, catalog, self.counters())
        ctes = p.with_(None) if p.is_("WITH") else ""
        for name, df in tables.items():
            if name.lower() in text.lower():
                df.createOrReplaceTempView(name)
        verb = p.need("INSERT", "REPLACE", "UPDATE", "DELETE").value.upper()
        made = {"INSERT": self._insert, "REPLACE": self._insert, "UPDATE": self._update, "DELETE": self._delete}[verb](p, ctes, verb)
        return made

    def _returning(self, p: Parser, t: dict, name: str, rows: DataFrame) -> DataFrame | None:
        if not p.take("RETURNING"):
            if not p.done() and not p.is_(";"):
                raise DialectError(f"near {p.peek().value!r}: syntax error")
            return None
        scope = Scope({name: {c["name"]: c["type"] for c in t["columns"]}})
        items = p.items(scope)
        view = rows.select(*[c["name"] for c in t["columns"]], *(["_rowid"] if "_rowid" in rows.columns else []))
        return view.alias(name).selectExpr(*["*" if n == "*" else f"{v.sql} AS {name_sql(n)}" for n, v in items]).drop("_rowid")

    def _insert(self, p: Parser, ctes: str, verb: str) -> DataFrame | None:
        action = "REPLACE" if verb == "REPLACE" else "ABORT"
        if p.take("OR"):
            action = p.need("REPLACE", "IGNORE", "ABORT", "FAIL", "ROLLBACK").value.upper()
        p.need("INTO")
        name = p.name()
        if (view := self._view(name)) is not None:
            return self._insert_view(p, ctes, view)
        t = self._table(name)
        if p.take("AS"):
            p.name()
        columns = [c["name"] for c in t["columns"] if not c.get("generated")]
        if p.take("("):
            columns = [p.name()]
            while p.take(","):
                columns.append(p.name())
            p.need(")")
        exact = False
        if p.take("DEFAULT"):
            p.need("VALUES")
            rows, exact = self.spark.range(1).select(), True
        else:
            exact = p.is_("VALUES")
            q = p.query()
            rows = self.spark.sql(ctes + q.sql)
            if len(rows.columns) != len(columns):
                raise DialectError(f"{len(rows.columns)} values for {len(columns)} columns")
            rows = rows.toDF(*columns)
        unknown = [c for c in columns if c.lower() not in {x["name"].lower() for x in t["columns"]}]
        if unknown:
            raise DialectError(f"table {name} has no column named {unknown[0]}")
        target, update, where = None, None, None
        if p.take("ON"):
            p.need("CONFLICT")
            if p.take("("):
                target = [p.name()]
                while p.take(","):
                    target.append(p.name())
                p.need(")")
            p.need("DO")
            if p.take("NOTHING"):
                action = "IGNORE"
            else:
                p.need("UPDATE")
                p.need("SET")
                types = {c["name"]: c["type"] for c in t["columns"]}
                scope = Scope({name: types, "excluded": types})
                p.bare_table = name
                update = self._sets(p, scope)
                where = truth(p.expr(scope)) if p.take("WHERE") else None
                p.bare_table = None
        if self._triggers("BEFORE", "INSERT", name):
            # What a BEFORE trigger sees: the rows as they will be, but for a row id that is yet to be given.
            rows = self._kept(rows)
            self._fire("BEFORE", "INSERT", name, self._completed(t, name, rows).withColumn("_rowid", F.lit(-1).cast("long")), None)
        if action in ("REPLACE", "IGNORE") or update is not None:
            fresh = self._merged(t, name, rows, exact, action, target, update, where)
        elif action == "FAIL":
            fresh = self._insert_until(t, name, rows, exact)
        else:
            try:
                fresh = self._insert_rows(t, name, rows, exact)
            except ConstraintError as e:
                raise (RolledBack(str(e)) if action == "ROLLBACK" else e) from None
        self._fire("AFTER", "INSERT", name, fresh, None)
        return self._returning(p, t, name, fresh)

    def _insert_view(self, p: Parser, ctes: str, view: str) -> None:
        if not self._triggers("INSTEAD OF", "INSERT", view):
            raise DialectError(f"cannot modify {view} because it is a view")
        shape = self._tables(text=view)[view]
        columns = list(shape.columns)
        if p.take("("):
            columns = [p.name()]
            while p.take(","):
                columns.append(p.name())
            p.need(")")
        given = self.spark.sql(ctes + p.query().sql).toDF(*columns)
        lower = {c.lower(): c for c in given.columns}
        rows = given.select(*[(F.col(name_sql(lower[f.name.lower()])) if f.name.lower() in lower else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.schema.fields])
        self._instead("INSERT", view, rows.withColumn("_rowid", F.lit(-1).cast("long")), None)

    def _changed_view(self, p: Parser, ctes: str, view: str, event: str) -> None:
        """UPDATE or DELETE on a view: the rows it hits, before and after, go to its triggers."""
        if not self._triggers("INSTEAD OF", event, view):
            raise DialectError(f"cannot modify {view} because it is a view")
        rows = self._tables(text=view)[view]
        scope = Scope({view: column_types(rows)})
        sets = {}
        if event == "UPDATE":
            p.need("SET")
            sets = {k.lower(): v for k, v in self._sets(p, scope).items()}
        test = truth(p.expr(scope)) if p.take("WHERE") else "true"
        self._kept(rows.withColumn("_rowid", F.monotonically_increasing_id())).createOrReplaceTempView("_td_target")
        old = self._kept(self.spark.sql(f"{ctes}SELECT {name_sql(view)}.* FROM _td_target AS {name_sql(view)} WHERE {test}"))
        old.createOrReplaceTempView("_td_target")
        shown = ", ".join(f"{sets[c.lower()] if c.lower() in sets else name_sql(view) + '.' + name_sql(c)} AS {name_sql(c)}" for c in rows.columns)
        new = self.spark.sql(f"{ctes}SELECT {name_sql(view)}._rowid, {shown} FROM _td_target AS {name_sql(view)}") if event == "UPDATE" else None
        self._instead(event, view, new, old)

    def _insert_until(self, t: dict, name: str, rows: DataFrame, exact: bool) -> DataFrame:
        """OR FAIL: rows in their order up to the first that breaks a constraint, which is then told."""
        made = self._kept(self._numbered(t, self._completed(t, name, rows), exact).withColumn("_seq", F.monotonically_increasing_id()))
        bad = [made.where(test).select("_seq") for test, _ in self._broken(t, name)]
        for _, values, where, columns in self._keys(t, name):
            keyed = self._keyed(made, values, where).join(made.select(F.col("_rowid").alias("_r"), "_seq"), F.col("_rowid") == F.col("_r"))
            ids = [f"_k{i}" for i in range(len(values))]
            repeated = keyed.join(keyed.groupBy(*ids).agg(F.min("_seq").alias("_first")), ids).where("_seq > _first")
            bad.append(repeated.select("_seq"))
            if t["files"]:
                there = self._keyed(self._read(t, self._near(t, made, values, columns)), values, where).select(*ids)
                bad.append(keyed.join(there, ids, "left_semi").select("_seq"))
        stops = [r[0] for b in bad if (r := b.agg(F.min("_seq")).first())[0] is not None]
        plain = made.drop("_seq")
        if not stops:
            return self._insert_rows(t, name, plain.drop("_rowid"), exact)
        before = made.where(F.col("_seq") < min(stops)).drop("_seq", "_rowid")
        fresh = self._insert_rows(t, name, before, exact)
        self._fire("AFTER", "INSERT", name, fresh, None)
        raise PartlyDone(f"constraint failed in {name}: {self.changed} rows came before it")

    def _sets(self, p: Parser, scope: Scope) -> dict[str, str]:
        out = {}
        while True:
            if p.take("("):
                names = [p.name()]
                while p.take(","):
                    names.append(p.name())
                p.need(")")
                p.need("=")
                p.need("(")
                for i, n in enumerate(names):
                    if i:
                        p.need(",")
                    out[n] = p.expr(scope).sql
                p.need(")")
            else:
                n = p.name()
                p.need("=")
                v = p.expr(scope)
                out[n] = f"CAST({v.sql} AS INT)" if v.type == "bool" else v.sql
            if not p.take(","):
                return out

    def _merged(self, t: dict, name: str, rows: DataFrame, exact: bool, action: str, target: list[str] | None, update: dict | None, where: str | None) -> DataFrame:
        """INSERT with conflicts. Of new rows with one key the last counts when rows are replaced, else the first."""
        from pyspark.sql import Window

        keys = self._keys(t, name)
        if target:
            keys = [k for k in keys if k[3] is not None and [c.lower() for c in k[3]] == [c.lower() for c in target]][:1]
            if not keys:
                raise DialectError("ON CONFLICT clause does not match any PRIMARY KEY or UNIQUE constraint")
        made = self._numbered(t, self._completed(t, name, rows), exact)
        if action == "IGNORE":
            for test, _ in self._broken(t, name):
                made = made.where(~F.coalesce(test, F.lit(False)))
        self._checked(t, name, made, keys=False)
        self.whole.add(self._name(name))
        seq = made.withColumn("_seq", F.monotonically_increasing_id())
        for _, values, test, _ in keys:
            w = Window.partitionBy(*values, *([test] if test is not None else [])).orderBy(F.col("_seq").desc() if action == "REPLACE" else F.col("_seq"))
            free = F.exists(F.array(*[v.isNull() for v in values]), lambda x: x) | (~F.coalesce(test, F.lit(False)) if test is not None else F.lit(False))
            seq = seq.withColumn("_k", F.row_number().over(w)).where((F.col("_k") == 1) | free).drop("_k")
        new = self._kept(seq.drop("_seq"))
        hits = None
        for _, values, test, columns in keys:
            ids = [f"_k{i}" for i in range(len(values))]
            there = self._located(t, self._near(t, new, values, columns))
            o = self._keyed(there, values, test).withColumnRenamed("_rowid", "_old").join(there.select(F.col("_rowid").alias("_o"), "_file"), F.col("_old") == F.col("_o"))
            if test is None:
                o = there.select(F.col("_rowid").alias("_old"), "_file", *[v.alias(f"_k{i}") for i, v in enumerate(values)]).dropna(subset=ids)
            h = o.join(self._keyed(new, values, test).withColumnRenamed("_rowid", "_new"), ids).select("_old", "_new", "_file")
            hits = h if hits is None else hits.union(h)
        hits = self._kept(hits.distinct()) if hits is not None else self.spark.createDataFrame([], "_old long, _new long, _file string")
        fresh = new.join(hits.select("_new").distinct(), F.col("_rowid") == F.col("_new"), "left_anti") if action != "REPLACE" else new
        changed = None
        if action == "REPLACE":
            gone = hits.select("_old").distinct()
            self._rewritten(t, hits, lambda df: df.join(gone, F.col("_rowid") == F.col("_old"), "left_anti"))
        elif update is not None:
            columns = [c["name"] for c in t["columns"]]
            lower = {k.lower(): v for k, v in update.items()}
            test = where or "true"

            def updated(df: DataFrame) -> DataFrame:
                new.createOrReplaceTempView("_td_new")
                df.createOrReplaceTempView("_td_old")
                hits.createOrReplaceTempView("_td_hits")
                shown = ", ".join(f"CASE WHEN h._old IS NOT NULL AND ({test}) THEN {lower[c.lower()]} ELSE {name_sql(name)}.{name_sql(c)} END AS {name_sql(c)}" if c.lower() in lower else f"{name_sql(name)}.{name_sql(c)}" for c in columns)
                return self.spark.sql(f"SELECT {name_sql(name)}._rowid, {shown} FROM _td_old AS {name_sql(name)} LEFT JOIN _td_hits h ON h._old = {name_sql(name)}._rowid LEFT JOIN _td_new AS excluded ON excluded._rowid = h._new")

            before = set(t["files"])
            self._rewritten(t, hits, updated)
            changed = self._read(t, sorted(set(t["files"]) - before)).join(hits.select("_old").distinct(), F.col("_rowid") == F.col("_old"), "left_semi")
        before = set(t["files"])
        n = self._write(t, fresh)
        added = self._read(t, sorted(set(t["files"]) - before))
        if n:
            t["next_rowid"] = max(t["next_rowid"], added.agg(F.max("_rowid")).first()[0] + 1)
        self.changed = n + (changed.count() if changed is not None else 0)
        self.total_changed += self.changed
        return added if changed is None else added.unionByName(changed)

    def _triggers(self, timing: str, event: str, name: str, changed: set[str] = frozenset()) -> list[dict]:
        return [x for _, x in sorted(self.state["triggers"].items()) if x["table"].lower() == name.lower() and x["event"] == event and x.get("timing", "AFTER") == timing and (not x["columns"] or {c.lower() for c in x["columns"]} & changed)]

    def _fire(self, timing: str, event: str, name: str, new: DataFrame | None, old: DataFrame | None, changed: set[str] = frozenset()) -> None:
        """Runs a table's triggers over all changed rows at once."""
        found = self._triggers(timing, event, name, changed)
        if not found:
            return
        if self.firing >= 8:
            raise DialectError("too many levels of trigger recursion")
        from tidemark.plans import ddl

        columns = [c for c in (new if new is not None else old).columns if c not in ("_rowid", "_file")]
        shown = lambda df, alias: df.select("_rowid", F.struct(*[F.col(name_sql(c)) for c in columns]).alias(alias))
        rows = shown(new, "NEW") if new is not None else None
        if old is not None:
            rows = shown(old, "OLD") if rows is None else rows.join(shown(old, "OLD"), "_rowid")
        rows = self._kept(rows)
        counts = self.changed, self.last_rowid
        self.firing += 1
        try:
            for x in found:
                for statement in x["body"]:
                    rows.createOrReplaceTempView("_td_trigger")
                    kind, text = ddl.set_based(statement, x["when"])
                    if kind == "dml":
                        self._dml(text)
                    elif text and (told := run_query(self.spark, text, {**self._tables(text=text), "_td_trigger": rows}).toDF("m").where("m IS NOT NULL").limit(1).collect()):
                        raise (RolledBack if kind == "raise ROLLBACK" else ConstraintError)(str(told[0][0]))
        finally:
            self.firing -= 1
        self.changed, self.last_rowid = counts

    def _instead(self, event: str, view: str, new: DataFrame | None, old: DataFrame | None) -> None:
        """A statement on a view: its INSTEAD OF triggers run, nothing else."""
        self.changed = (new if new is not None else old).count()
        self._fire("INSTEAD OF", event, view, new, old)

    def _view(self, name: str) -> str | None:
        return next((v for v in self.state["views"] if v.lower() == name.lower()), None)

    def _kept(self, df: DataFrame) -> DataFrame:
        """Rows that later steps must see alike: written beside the data and read back."""
        path = self.store.uri(f"staged/{uuid.uuid4().hex}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _update(self, p: Parser, ctes: str, verb: str) -> DataFrame | None:
        action = p.need("REPLACE", "IGNORE", "ABORT", "FAIL", "ROLLBACK").value.upper() if p.take("OR") else "ABORT"
        if action == "FAIL":
            raise DialectError("UPDATE OR FAIL depends on the order of rows, which a table here has not; use OR ABORT or OR IGNORE")
        name = p.name()
        if (view := self._view(name)) is not None:
            return self._changed_view(p, ctes, view, "UPDATE")
        t = self._table(name)
        types = {c["name"]: c["type"] for c in t["columns"]}
        scope = Scope({name: types})
        p.need("SET")
        sets_at = p.at
        p.skip_to("FROM", "WHERE", "RETURNING")
        source = None
        if p.take("FROM"):
            source = p.from_(scope)
        after = p.at
        p.at = sets_at
        sets = {k.lower(): v for k, v in self._sets(p, scope).items()}
        p.at = after
        test = truth(p.expr(scope)) if p.take("WHERE") else "true"
        self._located(t, self._pruned(p.text).get(self._name(name))).createOrReplaceTempView("_td_target")
        columns = [c["name"] for c in t["columns"]]
        shown = ", ".join(f"{sets[c.lower()] if c.lower() in sets else name_sql(name) + '.' + name_sql(c)} AS {name_sql(c)}" for c in columns)
        joined = f" CROSS JOIN {source}" if source else ""
        changed = self.spark.sql(f"{ctes}SELECT {name_sql(name)}._rowid, {name_sql(name)}._file, {shown} FROM _td_target AS {name_sql(name)}{joined} WHERE {test}")
        if source:
            changed = changed.dropDuplicates(["_rowid"])
        changed = self._kept(changed)
        key = next((c["name"] for c in t["columns"] if c.get("rowid")), None)
        drop = None
        if action in ("IGNORE", "REPLACE"):
            changed, drop = self._settled(t, name, changed, action)
        else:
            try:
                self._checked(t, name, changed, changed, keys=any(k[3] is None or k[2] is not None or any(c.lower() in sets for c in k[3]) for k in self._keys(t, name)))
            except ConstraintError as e:
                raise (RolledBack(str(e)) if action == "ROLLBACK" else e) from None
        before = self._kept(self._read(t).join(changed.select(F.col("_rowid").alias("_hit")), F.col("_rowid") == F.col("_hit"), "left_semi")) if self.foreign_keys or any(self._triggers(w, "UPDATE", name, set(sets)) for w in ("BEFORE", "AFTER")) else None
        if self._triggers("BEFORE", "UPDATE", name, set(sets)):
            self._fire("BEFORE", "UPDATE", name, changed, before, set(sets))
            # The trigger may have rewritten files of this very table.
            changed = self._kept(self._located(t).select("_rowid", "_file").join(changed.drop("_file"), "_rowid").select(*changed.columns))
        fresh = changed.withColumn("_row", F.coalesce(F.col(key), F.col("_rowid")) if key else F.col("_rowid"))

        def replaced(df: DataFrame) -> DataFrame:
            stay = df.join(changed.select(F.col("_rowid").alias("_hit")), F.col("_rowid") == F.col("_hit"), "left_anti")
            return stay.unionByName(self._completed_update(t, name, fresh))

        if drop is not None and not drop.isEmpty():
            self._rewritten(t, changed.select("_file").union(drop.select("_file")), lambda df: replaced(df.join(drop.select(F.col("_rowid").alias("_drop")), F.col("_rowid") == F.col("_drop"), "left_anti")))
        else:
            self._rewritten(t, changed, replaced)
        self.changed = changed.count()
        self.total_changed += self.changed
        if self.foreign_keys:
            self._parents_gone(name, before, "update", None if source else changed)
        self._fire("AFTER", "UPDATE", name, changed, before, set(sets))
        return self._returning(p, t, name, changed)

    def _settled(self, t: dict, name: str, changed: DataFrame, action: str) -> tuple[DataFrame, DataFrame | None]:
        """UPDATE OR IGNORE: the changed rows without those that would break a constraint. OR REPLACE: also the rows that make room.

        Of changed rows with one key the first (IGNORE) or the last (REPLACE) by row id stays. A row that is not changed
        after all keeps its old key, so IGNORE looks again until nothing more is dropped.
        """
        for test, message in self._broken(t, name):
            if action == "IGNORE":
                changed = changed.where(~F.coalesce(test, F.lit(False)))
            elif not changed.where(test).isEmpty():
                raise ConstraintError(message)
        changed, gone = self._kept(changed), None
        there = self._located(t)
        while True:
            lost, others = [], there.join(changed.select(F.col("_rowid").alias("_c")), F.col("_rowid") == F.col("_c"), "left_anti")
            for _, values, where, _ in self._keys(t, name):
                ids = [f"_k{i}" for i in range(len(values))]
                mine, their = self._keyed(changed, values, where), self._keyed(others, values, where)
                pick = F.min("_rowid") if action == "IGNORE" else F.max("_rowid")
                best = mine.groupBy(*ids).agg(pick.alias("_best"))
                lost.append(mine.join(best, ids).where("_rowid <> _best").select("_rowid"))
                if action == "IGNORE":
                    lost.append(mine.join(their.select(*ids), ids, "left_semi").select("_rowid"))
                else:
                    room = their.join(mine.select(*ids), ids, "left_semi").select(F.col("_rowid").alias("_g"))
                    gone = room if gone is None else gone.union(room)
            if not lost:
                return changed, None
            bad = lost[0]
            for b in lost[1:]:
                bad = bad.union(b)
            bad = self._kept(bad.distinct())
            if action == "REPLACE":
                gone = gone.union(bad.select(F.col("_rowid").alias("_g"))).distinct()
                left = self._kept(changed.join(bad.withColumnRenamed("_rowid", "_b"), F.col("_rowid") == F.col("_b"), "left_anti"))
                return left, self._kept(there.join(gone, F.col("_rowid") == F.col("_g"), "left_semi").select("_rowid", "_file"))
            if bad.isEmpty():
                return changed, None
            changed = self._kept(changed.join(bad.withColumnRenamed("_rowid", "_b"), F.col("_rowid") == F.col("_b"), "left_anti"))

    def _parents_gone(self, name: str, old: DataFrame, event: str, new: DataFrame | None = None) -> None:
        """What children do about rows of a parent that were deleted, or whose keys were changed (NO ACTION: they forbid it)."""
        for child, c in list(self.state["tables"].items()):
            for columns, parent, others, *actions in c["references"]:
                if parent.lower() != name.lower():
                    continue
                p = self._table(name)
                keys = others or p["keys"][0]
                ids = [f"_p{i}" for i in range(len(keys))]
                still = self._read(p).select(*[F.col(name_sql(k)).alias(i) for k, i in zip(keys, ids, strict=True)])
                lost = self._kept(old.select("_rowid", *[F.col(name_sql(k)).alias(i) for k, i in zip(keys, ids, strict=True)]).dropna(subset=ids).join(still, ids, "left_anti"))
                hit = self._located(c).join(lost.select(*ids).distinct(), [F.col(name_sql(x)) == F.col(i) for x, i in zip(columns, ids, strict=True)], "left_semi")
                if hit.isEmpty():
                    continue
                action = (actions[0] if actions else {}).get(event, "NO ACTION")
                if action in ("NO ACTION", "RESTRICT") or event == "update" and action == "CASCADE" and new is None:
                    raise ConstraintError("FOREIGN KEY constraint failed")
                hit = self._kept(hit)
                counts = self.changed
                if event == "delete" and action == "CASCADE":
                    self._deleted(c, child, hit)
                else:
                    moved = None
                    if action == "CASCADE":
                        to = new.select(F.col("_rowid").alias("_n"), *[F.col(name_sql(k)).alias(f"_to{i}") for i, k in enumerate(keys)])
                        moved = lost.join(to, F.col("_rowid") == F.col("_n")).drop("_rowid", "_n")
                        rows = hit.join(moved, [F.col(name_sql(x)) == F.col(i) for x, i in zip(columns, ids, strict=True)])
                        rows = rows.withColumns({x: F.col(f"_to{i}") for i, x in enumerate(columns)}).select(*hit.columns)
                    else:
                        by_name = {x["name"]: x for x in c["columns"]}
                        empty = lambda x: F.expr(Parser(by_name[x]["default"], lambda n: None).expr(Scope()).sql) if action == "SET DEFAULT" and by_name[x].get("default") else F.lit(None)
                        rows = hit.withColumns({x: empty(x).cast(SPARK[by_name[x]["type"]]) for x in columns})
                    rows = self._kept(rows)
                    self._checked(c, child, rows, rows)
                    gone = hit.select(F.col("_rowid").alias("_hit"))
                    self._rewritten(c, hit, lambda df, rows=rows, gone=gone: df.join(gone, F.col("_rowid") == F.col("_hit"), "left_anti").unionByName(rows.drop("_file")))
                self.changed = counts

    def _deleted(self, t: dict, name: str, gone: DataFrame) -> None:
        """Deletes located rows, and what hangs on them."""
        self._rewritten(t, gone, lambda df: df.join(gone.select(F.col("_rowid").alias("_hit")), F.col("_rowid") == F.col("_hit"), "left_anti"))
        if self.foreign_keys:
            self._parents_gone(name, gone, "delete")

    def _completed_update(self, t: dict, name: str, fresh: DataFrame) -> DataFrame:
        rows = fresh.select(F.col("_row").alias("_rowid"), *[c["name"] for c in t["columns"]])
        for c in t["columns"]:
            if c.get("generated"):
                parsed = Parser(c["generated"], lambda n: None)
                rows = rows.withColumn(c["name"], F.expr(parsed.expr(Scope({name: {x["name"]: x["type"] for x in t["columns"]}})).sql).cast(SPARK[c["type"]]))
        return rows

    def _delete(self, p: Parser, ctes: str, verb: str) -> DataFrame | None:
        p.need("FROM")
        name = p.name()
        if (view := self._view(name)) is not None:
            return self._changed_view(p, ctes, view, "DELETE")
        t = self._table(name)
        scope = Scope({name: {c["name"]: c["type"] for c in t["columns"]}})
        if p.take("WHERE"):
            test = truth(p.expr(scope))
            self._located(t, self._pruned(p.text).get(self._name(name))).createOrReplaceTempView("_td_target")
            gone = self._kept(self.spark.sql(f"{ctes}SELECT {name_sql(name)}.* FROM _td_target AS {name_sql(name)} WHERE {test}"))
            if self._triggers("BEFORE", "DELETE", name):
                self._fire("BEFORE", "DELETE", name, None, gone)
                gone = self._kept(self._located(t).join(gone.select(F.col("_rowid").alias("_hit")), F.col("_rowid") == F.col("_hit"), "left_semi"))
            self.changed = gone.count()
            self._deleted(t, name, gone)
        else:
            # Without a condition all files go; none is read.
            gone = self._read(t)
            if self._triggers("BEFORE", "DELETE", name):
                self._fire("BEFORE", "DELETE", name, None, gone)
                gone = self._read(t)
            self.changed = sum(f["rows"] for f in t["files"].values())
            t["files"] = {}
            if self.foreign_keys:
                self._parents_gone(name, gone, "delete")
        self.total_changed += self.changed
        self._fire("AFTER", "DELETE", name, None, gone)
        return self._returning(p, t, name, gone)

    # Schema.

    def _ddl(self, text: str) -> None:
        from tidemark.plans import ddl

        ddl.run(self, text)

    def _pragma(self, text: str) -> DataFrame | None:
        from tidemark.plans import ddl

        return ddl.pragma(self, text)

    def settings_changed(self) -> None:
        """A PRAGMA that is kept with the data: a commit like any other."""
        self._require_writable()
        if not self.in_transaction:
            self._publish()

    # Upkeep.

    def vacuum(self) -> None:
        """Compacts each table to files of about VACUUM_BYTES; the rows stay as they are. Files that are large enough already stay, too."""
        for t in self.state["tables"].values():
            small = sorted(f for f, told in t["files"].items() if told["bytes"] < VACUUM_BYTES // 2 or "shift" in told)
            if len(small) > 1:
                rows, size = self._read(t, small), sum(t["files"][f]["bytes"] for f in small)
                for f in small:
                    del t["files"][f]
                # Neighbouring row ids share a file, so that the ranges in the manifest tell files apart.
                self._write(t, rows.repartitionByRange(max(1, -(-size // VACUUM_BYTES)), "_rowid").sortWithinPartitions("_rowid"))

    def collect_garbage(self, keep: int = 10, older_than: float = 0.0) -> list[str]:
        self._require_writable()
        return self.log.sweep(keep, older_than)

    def checkpoint(self) -> None:
        self.log.checkpoint(self.base)

    def replicate(self, root: str) -> int:
        """Copies all records and data to another root, the newest commit last; returns its generation."""
        other = open_store(root, single_writer=True, spark=self.spark)
        head = self.log.load()
        live = sorted({f for t in head["tables"].values() for f in t["files"]} - set(other.list("data/")))
        _copy(self.spark, [(self.store.uri(f), other.uri(f)) for f in live])
        for key in ["db.json", *self.store.list("checkpoints/"), *self.store.list("commits/")]:
            if other.get(key) is None:
                other.put(key, self.store.get(key))
        return head["generation"]

    def fingerprint(self, name: str) -> tuple[int, str]:
        from tidemark.operators.fingerprint import fingerprint

        return tuple(fingerprint(self.table(name)).first())


def _copy(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Copies files from executors, each under a private name first, so no half file takes a whole one's place."""
    if not pairs:
        return
    if not all("://" not in u or u.startswith("file:") for pair in pairs for u in pair):
        # Between stores that only Spark's connectors open: streamed by the file system classes, never held in memory.
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        for a, b in pairs:
            one, two = path(a), path(b)
            jvm.org.apache.hadoop.fs.FileUtil.copy(one.getFileSystem(conf), one, two.getFileSystem(conf), two, False, True, conf)
        return
    from tidemark.shipping import ship_package

    ship_package(spark)
    spark.sparkContext.parallelize(pairs, max(1, min(len(pairs), 4096))).foreach(copy_file)


def copy_file(pair: tuple[str, str]) -> None:
    import os
    import shutil

    a, b = (u.removeprefix("file://") for u in pair)
    os.makedirs(os.path.dirname(b), exist_ok=True)
    private = f"{b}.{uuid.uuid4().hex}.tmp"
    shutil.copyfile(a, private)
    os.replace(private, b)
