"""Schema statements and PRAGMAs of a versioned database."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dialect import DialectError, Parser, Scope, affinity, translate
from .script import tokens, unquoted

_ENDS = ("PRIMARY", "NOT", "NULL", "UNIQUE", "CHECK", "DEFAULT", "COLLATE", "REFERENCES", "GENERATED", "AS", "CONSTRAINT")


def _inside(p: Parser) -> str:
    """The text between two parentheses."""
    p.need("(")
    start = p.at
    p.skip_to(")")
    told = p.text[p.toks[start].start : p.toks[p.at - 1].end]
    p.need(")")
    return told


def _names(p: Parser) -> list[str]:
    p.need("(")
    out = [p.name()]
    p.take("ASC", "DESC")
    while p.take(","):
        out.append(p.name())
        p.take("ASC", "DESC")
    p.need(")")
    return out


def _reference(p: Parser) -> tuple[str, list[str], dict[str, str]]:
    parent = p.name()
    columns = _names(p) if p.is_("(") else []
    actions = {}
    while p.is_("ON", "MATCH", "DEFERRABLE", "NOT"):
        if p.take("ON"):
            event = p.need("DELETE", "UPDATE").value.lower()
            word = p.name().upper()
            actions[event] = f"{word} {p.name().upper()}" if word in ("SET", "NO") else word
        elif p.take("MATCH"):
            p.name()
        else:
            if p.is_("NOT") and not (p.peek(1) is not None and p.peek(1).is_("DEFERRABLE")):
                break
            p.take("NOT")
            p.need("DEFERRABLE")
            if p.take("INITIALLY"):
                p.name()
    return parent, columns, actions


def _column(p: Parser, t: dict, number: int) -> dict:
    c = {"name": p.name(), "id": f"c{number}", "notnull": False, "pk": 0}
    words = []
    while not p.done() and not p.is_(",", ")", *_ENDS):
        if p.is_("("):
            words.append(f"({_inside(p)})")
        else:
            words.append(p.name())
    c["declared"] = " ".join(words)
    c["type"] = affinity(c["declared"]) if words else "text"
    while not p.done() and not p.is_(",", ")"):
        if p.take("CONSTRAINT"):
            p.name()
        elif p.take("PRIMARY"):
            p.need("KEY")
            p.take("ASC", "DESC")
            p.take("AUTOINCREMENT")
            c["pk"] = 1
            c["rowid"] = c["declared"].upper() == "INTEGER"
            t["keys"].append([c["name"]])
        elif p.take("NOT"):
            p.need("NULL")
            c["notnull"] = True
        elif p.take("NULL"):
            pass
        elif p.take("UNIQUE"):
            t["keys"].append([c["name"]])
        elif p.take("CHECK"):
            t["checks"].append(_inside(p))
        elif p.take("COLLATE"):
            c["collate"] = p.name().upper()
            if c["collate"] not in ("BINARY", "NOCASE", "RTRIM"):
                raise DialectError(f"no such collation sequence: {c['collate']}")
        elif p.take("DEFAULT"):
            if p.is_("("):
                c["default"] = _inside(p)
            else:
                sign = "-" if p.take("-") else ""
                p.take("+")
                c["default"] = sign + p.peek().value
                p.at += 1
        elif p.take("REFERENCES"):
            t["references"].append([[c["name"]], *_reference(p)])
        elif p.take("GENERATED"):
            p.need("ALWAYS")
        elif p.take("AS"):
            c["generated"] = _inside(p)
            p.take("STORED", "VIRTUAL")
        else:
            raise DialectError(f"near {p.peek().value!r}: syntax error")
    return c


def _new_table(sql: str) -> dict:
    return {"id": uuid.uuid4().hex[:12], "columns": [], "keys": [], "checks": [], "references": [], "files": {}, "next_rowid": 1, "next_column": 1, "sql": sql}


def _exists(db, name: str) -> bool:
    return any(name.lower() == n.lower() for n in [*db.state["tables"], *db.state["views"]])


def _create_table(db, p: Parser) -> None:
    guarded = p.take("IF") and p.need("NOT") and p.need("EXISTS")
    name = p.name()
    if _exists(db, name):
        if guarded:
            return
        raise DialectError(f"table {name} already exists")
    t = _new_table(p.text.strip().rstrip(";"))
    if p.take("AS"):
        made = db.query(p.text[p.peek().start :].rstrip("; \n"))
        from tidemark.session import column_types

        for c, kind in column_types(made).items():
            kind = {"bool": "int", "ts": "text", None: "text"}.get(kind, kind)
            t["columns"].append({"name": c, "id": f"c{t['next_column']}", "notnull": False, "pk": 0, "declared": {"int": "INT", "real": "REAL", "text": "TEXT", "blob": "BLOB"}[kind], "type": kind})
            t["next_column"] += 1
        db.state["tables"][name] = t
        db._insert_rows(t, name, made, exact=False)
        return
    p.need("(")
    while True:
        p.take("CONSTRAINT") and p.name()
        if p.take("PRIMARY"):
            p.need("KEY")
            names = _names(p)
            t["keys"].append(names)
            for c in t["columns"]:
                if c["name"].lower() in [n.lower() for n in names]:
                    c["pk"] = 1 + [n.lower() for n in names].index(c["name"].lower())
                    c["rowid"] = len(names) == 1 and c["declared"].upper() == "INTEGER"
        elif p.take("UNIQUE"):
            t["keys"].append(_names(p))
        elif p.take("CHECK"):
            t["checks"].append(_inside(p))
        elif p.take("FOREIGN"):
            p.need("KEY")
            names = _names(p)
            p.need("REFERENCES")
            t["references"].append([names, *_reference(p)])
        else:
            t["columns"].append(_column(p, t, t["next_column"]))
            t["next_column"] += 1
        if not p.take(","):
            break
    p.need(")")
    db.state["tables"][name] = t


def _create_virtual(db, p: Parser) -> None:
    """Boxes (rtree) and texts (fts5) as plain tables: box conditions open files by their ranges, MATCH searches the text columns."""
    p.need("TABLE")
    guarded = p.take("IF") and p.need("NOT") and p.need("EXISTS")
    name = p.name()
    if _exists(db, name):
        if guarded:
            return
        raise DialectError(f"table {name} already exists")
    p.need("USING")
    module = p.name().lower()
    if module not in ("rtree", "rtree_i32", "fts5"):
        raise DialectError(f"no such module: {module}")
    p.need("(")
    columns: list[tuple[str, bool]] = []
    while True:
        extra = p.take("+")
        column = p.name()
        option = p.take("=")
        while not p.is_(",", ")"):
            p.at += 1
        if not option:
            columns.append((column, extra))
        if not p.take(","):
            break
    p.need(")")
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    if module == "fts5":
        told = ", ".join(f"{quoted(c)} TEXT" for c, _ in columns)
    else:
        axes = [c for c, extra in columns[1:] if not extra]
        if len(axes) % 2 or not 2 <= len(axes) <= 10:
            raise DialectError("an rtree has a key and 1 to 5 pairs of columns")
        kind = "INTEGER" if module == "rtree_i32" else "REAL"
        told = f"{quoted(columns[0][0])} INTEGER PRIMARY KEY, " + ", ".join(f"{quoted(c)} {'TEXT' if extra else kind}" for c, extra in columns[1:])
        told += "".join(f", CHECK ({quoted(a)} <= {quoted(b)})" for a, b in zip(axes[::2], axes[1::2], strict=True))
    inner = Parser(f"{quoted(name)} ({told})", lambda n: None)
    _create_table(db, inner)
    db.state["tables"][name]["sql"] = p.text.strip().rstrip(";")


def _alter(db, p: Parser) -> None:
    p.need("TABLE")
    name = db._name(p.name())
    t = db._table(name)
    if p.take("RENAME"):
        if p.take("TO"):
            new = p.name()
            if _exists(db, new):
                raise DialectError(f"there is already another table or index with this name: {new}")
            t["sql"] = renamed(t["sql"], name, new, 1)
            db.state["tables"][new] = db.state["tables"].pop(name)
            for kind in ("indexes", "triggers"):
                for x in db.state[kind].values():
                    if x["table"].lower() == name.lower():
                        x["table"], x["sql"] = new, renamed(x["sql"], name, new)
                    if kind == "triggers":
                        x["body"] = [renamed(b, name, new) for b in x["body"]]
            for other in db.state["tables"].values():
                for r in other["references"]:
                    r[1] = new if r[1].lower() == name.lower() else r[1]
            db.state["views"] = {n: renamed(v, name, new) for n, v in db.state["views"].items()}
            return
        p.take("COLUMN")
        old = p.name()
        p.need("TO")
        new = p.name()
        c = _find(t, name, old)
        if any(x["name"].lower() == new.lower() and x is not c for x in t["columns"]):
            raise DialectError(f"duplicate column name: {new}")
        t["keys"] = [[new if k.lower() == old.lower() else k for k in key] for key in t["keys"]]
        t["checks"] = [renamed(x, old, new) for x in t["checks"]]
        t["sql"] = renamed(t["sql"], old, new)
        for x in t["columns"]:
            if x.get("generated"):
                x["generated"] = renamed(x["generated"], old, new)
        for r in t["references"]:
            r[0] = [new if k.lower() == old.lower() else k for k in r[0]]
        for other in db.state["tables"].values():
            for r in other["references"]:
                if r[1].lower() == name.lower():
                    r[2] = [new if k.lower() == old.lower() else k for k in r[2]]
        for kind in ("indexes", "triggers"):
            for x in db.state[kind].values():
                if x["table"].lower() == name.lower():
                    x["columns"], x["sql"] = [renamed(k, old, new) for k in x["columns"]], renamed(x["sql"], old, new)
                    key = "where" if kind == "indexes" else "when"
                    x[key] = x[key] and renamed(x[key], old, new)
                    if kind == "triggers":
                        # Only what belongs to the trigger's own row.
                        x["body"] = [renamed(b, old, new, after=("NEW", "OLD")) for b in x["body"]]
        for n, body in db.state["views"].items():
            named = {tok.value.strip('"`[]').lower() for tok in tokens(body)}
            others = [u for m, u in db.state["tables"].items() if m.lower() in named and m != name]
            if name.lower() in named and not any(x["name"].lower() == old.lower() for u in others for x in u["columns"]):
                db.state["views"][n] = renamed(body, old, new)
        c["name"] = new
    elif p.take("ADD"):
        p.take("COLUMN")
        c = _column(p, t, t["next_column"])
        if any(x["name"].lower() == c["name"].lower() for x in t["columns"]):
            raise DialectError(f"duplicate column name: {c['name']}")
        if c["notnull"] and c.get("default") is None:
            raise DialectError("Cannot add a NOT NULL column with default value NULL")
        rows = db._read(t) if c.get("default") is not None and t["files"] else None
        t["next_column"] += 1
        t["columns"].append(c)
        if rows is not None:
            # Rows that are there get the default; without one old files simply lack the column.
            default = Parser(c["default"], lambda n: None).expr(Scope()).sql
            t["files"] = {}
            db._write(t, rows.withColumn(c["name"], F.expr(default)))
    else:
        p.need("DROP")
        p.take("COLUMN")
        c = _find(t, name, p.name())
        if c["pk"] or any(c["name"].lower() == k.lower() for key in [*t["keys"], *(x["columns"] for x in db.state["indexes"].values() if x["table"] == name)] for k in key):
            raise DialectError(f"cannot drop column {c['name']!r}: it is part of a key")
        t["columns"].remove(c)


def renamed(text: str, old: str, new: str, most: int = 0, after: tuple[str, ...] = ()) -> str:
    """The text with an identifier replaced (the first `most` times; behind `after.` only, if told); other text stays as it is."""
    out, last, done, toks = [], 0, 0, tokens(text)
    for i, tok in enumerate(toks):
        if tok.kind not in ("word", "name") or unquoted(tok).lower() != old.lower() or most and done >= most:
            continue
        if after and not (i > 1 and toks[i - 1].is_(".") and toks[i - 2].is_(*after)):
            continue
        if i + 1 < len(toks) and tok.kind == "word" and toks[i + 1].is_("(") and i and not toks[i - 1].is_("TABLE", "INTO", "ON", "EXISTS", ",", "("):
            continue  # a function of that name
        plain = re.fullmatch(r"[A-Za-z_]\w*", new) is not None
        out += [text[last : tok.start], new if plain else '"' + new.replace('"', '""') + '"']
        last, done = tok.end, done + 1
    return "".join([*out, text[last:]])


def _find(t: dict, table: str, column: str) -> dict:
    for c in t["columns"]:
        if c["name"].lower() == column.lower():
            return c
    raise DialectError(f"no such column: {table}.{column}")


def run(db, text: str) -> None:
    p = Parser(text, lambda n: None)
    verb = p.need("CREATE", "DROP", "ALTER", "REINDEX", "ANALYZE").value.upper()
    if verb in ("REINDEX", "ANALYZE"):
        return
    if verb == "ALTER":
        return _alter(db, p)
    if verb == "DROP":
        what = p.need("TABLE", "VIEW", "INDEX", "TRIGGER").value.lower()
        guarded = p.take("IF") and p.need("EXISTS")
        name, kind = p.name(), what + ("es" if what == "index" else "s")
        found = next((n for n in db.state[kind] if n.lower() == name.lower()), None)
        if found is None:
            if guarded:
                return
            raise DialectError(f"no such {what}: {name}")
        del db.state[kind][found]
        if what == "table":
            for other in ("indexes", "triggers"):
                db.state[other] = {n: x for n, x in db.state[other].items() if x["table"].lower() != found.lower()}
        if what == "view":
            db.state["triggers"] = {n: x for n, x in db.state["triggers"].items() if x["table"].lower() != found.lower()}
        return
    if p.take("VIRTUAL"):
        return _create_virtual(db, p)
    unique = p.take("UNIQUE")
    p.take("TEMP", "TEMPORARY")
    if p.take("TABLE"):
        _create_table(db, p)
    elif p.take("VIEW"):
        guarded = p.take("IF") and p.need("NOT") and p.need("EXISTS")
        name = p.name()
        if _exists(db, name):
            if guarded:
                return
            raise DialectError(f"table {name} already exists")
        columns = _names(p) if p.is_("(") else []
        p.need("AS")
        body = text[p.peek().start :].strip().rstrip(";")
        if columns:
            body = f"WITH _v({', '.join(columns)}) AS ({body}) SELECT * FROM _v"
        translate(body)
        db.state["views"][name] = body
    elif p.take("INDEX"):
        guarded = p.take("IF") and p.need("NOT") and p.need("EXISTS")
        name = p.name()
        if name in db.state["indexes"]:
            if guarded:
                return
            raise DialectError(f"index {name} already exists")
        p.need("ON")
        table = db._name(p.name())
        t = db._table(table)
        p.need("(")
        columns = []
        while True:
            start = p.at
            p.expr(Scope({table: {c["name"]: c["type"] for c in t["columns"]}}))
            columns.append(p.text[p.toks[start].start : p.toks[p.at - 1].end].strip('"`[]'))
            p.take("ASC", "DESC")
            if not p.take(","):
                break
        p.need(")")
        where = text[p.toks[p.at + 1].start :].strip().rstrip(";") if p.is_("WHERE") else None
        db.state["indexes"][name] = {"table": table, "columns": columns, "unique": bool(unique), "where": where, "sql": text.strip().rstrip(";")}
        if unique:
            from tidemark.database import ConstraintError

            for told, values, test, _ in db._keys(t, table)[len(t["keys"]) :]:
                rows = db._keyed(db._read(t), values, test)
                if not rows.groupBy(*[f"_k{i}" for i in range(len(values))]).count().where("count > 1").isEmpty():
                    raise ConstraintError(f"UNIQUE constraint failed: {told}")
    else:
        _create_trigger(db, p)


def _create_trigger(db, p: Parser) -> None:
    """Triggers run once for all rows that a statement changes, before it writes them or after."""
    p.need("TRIGGER")
    guarded = p.take("IF") and p.need("NOT") and p.need("EXISTS")
    name = p.name()
    if name in db.state["triggers"]:
        if guarded:
            return
        raise DialectError(f"trigger {name} already exists")
    timing = "AFTER" if p.take("AFTER") else "INSTEAD OF" if p.take("INSTEAD") and p.need("OF") else "BEFORE"
    p.take("BEFORE")
    event = p.need("INSERT", "UPDATE", "DELETE").value.upper()
    columns = []
    if p.take("OF"):
        columns = [p.name()]
        while p.take(","):
            columns.append(p.name())
    p.need("ON")
    table = p.name()
    view = next((v for v in db.state["views"] if v.lower() == table.lower()), None)
    if (view is not None) != (timing == "INSTEAD OF"):
        raise DialectError(f"cannot create {timing} trigger on {'view' if view else 'table'}: {table}")
    if view is None:
        table = db._name(table)
        db._table(table)
    if p.take("FOR"):
        p.need("EACH")
        p.need("ROW")
    when = None
    if p.take("WHEN"):
        start = p.at
        p.skip_to("BEGIN")
        when = p.text[p.toks[start].start : p.toks[p.at - 1].end]
    p.need("BEGIN")
    body = []
    while not p.take("END"):
        start, depth = p.at, 0
        while depth or not p.is_(";"):
            if p.done():
                raise DialectError("incomplete input")
            depth += p.is_("CASE") - (p.is_("END") and depth > 0)
            p.at += 1
        told = p.text[p.toks[start].start : p.toks[p.at].start].strip()
        p.need(";")
        if not p.toks[start].is_("INSERT", "REPLACE", "UPDATE", "DELETE", "SELECT"):
            raise DialectError(f"near {p.toks[start].value!r}: syntax error")
        set_based(told, when)
        body.append(told)
    db.state["triggers"][name] = {"table": view or table, "timing": timing, "event": event, "columns": columns, "when": when, "body": body, "sql": p.text.strip().rstrip(";")}


def set_based(statement: str, when: str | None) -> tuple[str, str]:
    """A statement of a trigger for one row as one for all rows of `_td_trigger`, which has NEW and OLD as structs.

    The first of the pair tells what it is: dml, or raise for a query that gives messages where RAISE is reached.
    """
    toks = tokens(statement)
    verb = toks[0].value.upper()
    depth, at = 0, len(statement)
    for t in toks:
        depth += t.is_("(") - t.is_(")")
        if depth == 0 and t.is_("WHERE"):
            at = t.start
    head, test = statement[:at], statement[at + 5 :].strip()
    both = " AND ".join(f"({x})" for x in (test, when) if x)
    where = f" WHERE {both}" if both else ""
    if verb == "UPDATE":
        if any(t.is_("FROM") for t in toks if t.start < at):
            raise DialectError("a trigger's UPDATE must have no FROM")
        return "dml", f"{head} FROM _td_trigger{where}"
    if verb == "DELETE":
        return "dml", f"{head} WHERE EXISTS (SELECT 1 FROM _td_trigger{where})"
    if verb == "SELECT":
        message = next((i for i, t in enumerate(toks) if t.is_("RAISE")), None)
        if message is None:
            return "raise", ""
        end = next(i for i in range(message, len(toks)) if toks[i].is_(")"))
        action = toks[message + 2].value.upper()
        if action == "IGNORE":
            raise DialectError("RAISE(IGNORE) is not supported")
        told = toks[end - 1].value
        text = statement[: toks[message].start] + told + statement[toks[end].end :]
        shift = len(text) - len(statement)
        cut = len(text) if at == len(statement) else at + shift if at > toks[message].start else at
        body = text[toks[0].end : cut]
        return f"raise {action}", f"SELECT {body} FROM _td_trigger{where}"
    p = Parser(statement, lambda n: None)
    p.skip_to("VALUES", "SELECT")
    head, where = statement[: p.peek().start], f" WHERE {when}" if when else ""
    if p.take("VALUES"):
        return "dml", f"{head}SELECT {_inside(p)} FROM _td_trigger{where}"
    body = statement[p.peek().end :]
    if any(t.is_("FROM") for t in tokens(body)):
        raise DialectError("a trigger's INSERT ... SELECT must have no FROM")
    at = next((t.start for t in tokens(body) if t.is_("WHERE")), len(body))
    test = body[at + 5 :].strip()
    both = " AND ".join(f"({x})" for x in (test, when) if x)
    return "dml", f"{head}SELECT {body[:at]} FROM _td_trigger{' WHERE ' + both if both else ''}"


def pragma(db, text: str) -> DataFrame | None:
    found = tokens(text)
    name = found[1].value.lower()
    arg = None
    if len(found) > 3 and found[2].is_("=", "("):
        arg = found[3].value.strip("'\"`[]")
    rows, schema = None, None
    if name in ("table_info", "table_xinfo"):
        t = db._table(arg)
        rows = [(i, c["name"], c["declared"], int(c["notnull"]), c.get("default"), c["pk"]) for i, c in enumerate(t["columns"])]
        schema = "cid int, name string, type string, notnull int, dflt_value string, pk int"
    elif name == "index_list":
        named = [(n, x) for n, x in sorted(db.state["indexes"].items()) if x["table"].lower() == arg.lower()]
        rows = [(i, n, int(x["unique"]), "c", int(x["where"] is not None)) for i, (n, x) in enumerate(named)]
        schema = "seq int, name string, unique int, origin string, partial int"
    elif name == "index_info":
        x = db.state["indexes"].get(arg)
        if x is not None:
            names = [c["name"].lower() for c in db._table(x["table"])["columns"]]
            rows = [(i, names.index(c.lower()) if c.lower() in names else -2, c if c.lower() in names else None) for i, c in enumerate(x["columns"])]
        rows, schema = rows or [], "seqno int, cid int, name string"
    elif name == "database_list":
        rows, schema = [(0, "main", db.store.root)], "seq int, name string, file string"
    elif name == "foreign_keys":
        if arg is not None:
            db.foreign_keys = arg.lower() in ("1", "on", "true", "yes")
            return None
        rows, schema = [(int(db.foreign_keys),)], "foreign_keys int"
    elif name == "query_only":
        if arg is not None:
            db.read_only = arg.lower() in ("1", "on", "true", "yes")
            return None
        rows, schema = [(int(db.read_only),)], "query_only int"
    elif name == "foreign_key_list":
        rows = [(i, j, parent, c, (others[j] if j < len(others) else None)) for i, (columns, parent, others) in enumerate(db._table(arg)["references"]) for j, c in enumerate(columns)]
        schema = "id int, seq int, table string, from string, to string"
    elif name in ("journal_mode", "synchronous", "wal_autocheckpoint"):
        rows, schema = [({"journal_mode": "wal", "synchronous": "2", "wal_autocheckpoint": "0"}[name],)], f"{name} string"
    elif name == "wal_checkpoint":
        db.checkpoint()
        rows, schema = [(0, db.generation, db.generation)], "busy int, log long, checkpointed long"
    elif name == "integrity_check":
        db.log.load(db.generation)
        rows, schema = [("ok",)], "integrity_check string"
    elif name in ("user_version", "application_id"):
        settings = db.state.setdefault("settings", {})
        if arg is not None:
            sign = -1 if arg == "-" else 1
            settings[name] = sign * int(found[4].value if arg == "-" else arg)
            db.settings_changed()
            return None
        rows, schema = [(settings.get(name, 0),)], f"{name} int"
    else:
        return None
    return db.spark.createDataFrame(rows, schema)
