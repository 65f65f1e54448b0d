"""Results on the way out: text rows, typed JSON lines with bounds, tabs, CSV, SQL dumps, schema trees, pages and edits."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tidemark.plans import script
from tidemark.plans.script import DialectError

MOST_ROWS, MOST_BYTES, MOST_OUTPUT = 100_000, 8 << 20, 32 << 20
MOST_OBJECTS = 10_000
PAGE_SIZE, MOST_PAGE, MOST_OFFSET = 200, 10_000, 1 << 31
EMPTY = '{"ok":true,"rows":0,"columns":[],"data":[]}'


class TooLarge(RuntimeError):
    pass


def cell_text(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    return repr(value) if isinstance(value, float) else str(value)


def text_rows(df: DataFrame) -> Iterator[str]:
    for row in df.toLocalIterator():
        yield " | ".join(map(cell_text, row))


def tab_rows(df: DataFrame) -> Iterator[str]:
    """Columns between tabs, then the end mark with the number of rows."""
    n = 0
    for row in df.toLocalIterator():
        n += 1
        yield "\t".join(map(cell_text, row))
    yield f"# end {n}"


def _string(text: str) -> str:
    """A JSON string; control characters as \\u00xx, the rest as it is."""
    return '"' + re.sub(r'[\x00-\x1f"\\]', lambda m: "\\" + m[0] if m[0] in '"\\' else f"\\u{ord(m[0]):04x}", text) + '"'


def cell_json(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return repr(value) if math.isfinite(value) else _string("NaN" if value != value else "Inf" if value > 0 else "-Inf")
    return _string(cell_text(value))


def json_line(df: DataFrame | None) -> str:
    """One statement's rows as one line; more than the bounds is an error, never a part."""
    if df is None:
        return EMPTY
    rows, size = [], 0
    for row in df.limit(MOST_ROWS + 1).toLocalIterator():
        told = "[" + ",".join(map(cell_json, row)) + "]"
        size += len(told) + 1
        if len(rows) == MOST_ROWS:
            raise TooLarge(f"result exceeds {MOST_ROWS} rows")
        if size > MOST_BYTES:
            raise TooLarge(f"result exceeds {MOST_BYTES} bytes")
        rows.append(told)
    return f'{{"ok":true,"rows":{len(rows)},"columns":[{",".join(map(_string, df.columns))}],"data":[{",".join(rows)}]}}'


def error_line(message: str) -> str:
    return f'{{"ok":false,"error":{_string(message)}}}'


def run_json(db, text: str) -> tuple[list[str], int]:
    """Every statement of a script as a line; stops at the first that fails. Exit code 0, 1 (a statement failed) or 2 (nothing to run)."""
    if not text.strip():
        return [error_line("--json requires a SQL argument")], 2
    out, size = [], 0
    for statement in script.statements(text):
        try:
            line = json_line(db.statement(statement))
            size += len(line) + 1
            if size > MOST_OUTPUT:
                raise TooLarge(f"output exceeds {MOST_OUTPUT} bytes")
            out.append(line)
        except Exception as e:
            return [*out, error_line(str(e).split("\n")[0])], 1
    return out, 0


def schema_json(db, with_sql: bool = False) -> str:
    """Tables and views with columns and indexes."""
    state, out = db.state, []
    if len(state["tables"]) + len(state["views"]) > MOST_OBJECTS:
        raise TooLarge(f"schema exceeds {MOST_OBJECTS} objects")
    by_alias = {t: {"int": "INTEGER", "real": "REAL", "text": "TEXT", "blob": "BLOB"}.get(t, "") for t in ("int", "real", "text", "blob")}
    for name in sorted([*state["tables"], *state["views"]]):
        if name in state["tables"]:
            t = state["tables"][name]
            columns = [{"name": c["name"], "type": c["declared"], "pk": c["pk"], "notnull": int(c["notnull"])} for c in t["columns"]]
            indexes = [{"name": n, "unique": int(x["unique"]), "columns": x["columns"]} for n, x in sorted(state["indexes"].items()) if x["table"] == name]
            made = {"name": name, "type": "table", "columns": columns, "indexes": indexes}
            sql = t["sql"]
        else:
            from tidemark.session import column_types

            types = column_types(db.query(f'SELECT * FROM "{name}"'))
            made = {"name": name, "type": "view", "columns": [{"name": c, "type": by_alias.get(k, ""), "pk": 0, "notnull": 0} for c, k in types.items()], "indexes": []}
            sql = f"CREATE VIEW {name} AS {state['views'][name]}"
        out.append(made | ({"sql": sql} if with_sql else {}))
    return json.dumps({"ok": True, "tables": out}, separators=(",", ":"), ensure_ascii=False)


def quoted_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


_PAGED = re.compile(r'\s*select\s+\*\s+from\s+("(?:[^"]|"")+"|[A-Za-z_][A-Za-z0-9_$]*)\s*;?\s*', re.IGNORECASE)


def paged_sql(text: str | None, page: int, size: int, count: bool = False) -> str | None:
    """A page of `SELECT * FROM table`, or its count; None for any other statement and for pages too far out."""
    m = _PAGED.fullmatch(text or "")
    if m is None:
        return None
    name = m[1] if m[1].startswith('"') else quoted_name(m[1])
    if count:
        return f"SELECT COUNT(*) FROM {name};"
    size = PAGE_SIZE if size < 1 else min(size, MOST_PAGE)
    offset = (max(page, 1) - 1) * size
    return None if offset >= MOST_OFFSET else f"SELECT * FROM {name} LIMIT {size} OFFSET {offset};"


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex().upper()}'"
    return "'" + str(value).replace("'", "''") + "'"


class Number(str):
    """A number that keeps its spelling in an edit."""


def edit_sql(op: str, table: str, columns: list[str], old: list | None, new: list | None, key: list[str]) -> str:
    """The statement for a change of one row of a grid. Rows are found by their key; a null there is IS NULL."""
    say = lambda v: str(v) if isinstance(v, Number) else literal(v)
    if len(columns) > 64:
        raise DialectError("too many columns")
    names = [quoted_name(c) for c in columns]
    if op == "insert":
        return f"INSERT INTO {quoted_name(table)} ({','.join(names)}) VALUES ({','.join(map(say, new))});"
    if not key:
        raise DialectError("a table without a key cannot be edited")
    tests = []
    for k in key:
        v = old[columns.index(k)]
        tests.append(f"{quoted_name(k)} IS NULL" if v is None else f"{quoted_name(k)}={say(v)}")
    where = " AND ".join(tests)
    if op == "delete":
        return f"DELETE FROM {quoted_name(table)} WHERE {where};"
    if op == "update":
        return f"UPDATE {quoted_name(table)} SET {','.join(f'{n}={say(v)}' for n, v in zip(names, new, strict=True))} WHERE {where};"
    raise DialectError(f"unknown edit {op!r}")


def dump(db) -> Iterator[str]:
    """A script that makes the database again."""
    yield "BEGIN;"
    for name, t in sorted(db.state["tables"].items()):
        yield t["sql"] + ";"
        columns = [c["name"] for c in t["columns"] if not c.get("generated")]
        for row in db.table(name).select(*columns).toLocalIterator():
            yield f"INSERT INTO {quoted_name(name)} ({','.join(map(quoted_name, columns))}) VALUES ({','.join(map(literal, row))});"
    for x in db.state["indexes"].values():
        yield x["sql"] + ";"
    for name, text in db.state["views"].items():
        yield f"CREATE VIEW {name} AS {text};"
    yield "COMMIT;"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def meta(db, command: str) -> list[str]:
    """Dot commands of the prompt."""
    word, _, rest = command.strip().partition(" ")
    if word == ".tables":
        return db.tables()
    if word == ".schema":
        return [r["sql"] + ";" for r in db.catalog().orderBy("name").collect() if not rest or r["tbl_name"].lower() == rest.strip().lower()]
    if word == ".status":
        return [f"{k}: {v}" for k, v in db.status().items()]
    if word == ".version":
        from tidemark import __version__

        return [__version__]
    if word == ".help":
        return [".clear", ".exit", ".help", ".quit", ".schema [table]", ".status", ".tables", ".version"]
    if word in (".clear", ".quit", ".exit"):
        return []
    raise DialectError(f"unknown command {word}")
