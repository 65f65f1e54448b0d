"""Statements of the embedded dialect as Spark SQL.

A recursive-descent parser over tokens that writes Spark SQL as it reads. Static
types are inferred where the dialect's meaning depends on them (whole-number
division, truth values, casts); Catalyst does everything else.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from tidemark.functions import aggregates, datetimes, jsons, scalars
from tidemark.functions.core import Value, as_int, as_real, as_text, known, lowered, plain, quoted, truth, wider

from .script import DialectError, Token, tokens, unquoted

Types = dict[str, str | None]


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclasses.dataclass
class Scope:
    """Columns in sight: by alias, and all together; `json` has the aliases of json_each and json_tree."""

    tables: dict[str, Types] = dataclasses.field(default_factory=dict)
    json: set[str] = dataclasses.field(default_factory=set)
    outer: Scope | None = None

    def type_of(self, column: str, table: str | None) -> str | None:
        scope: Scope | None = self
        while scope is not None:
            for alias, columns in scope.tables.items():
                if table is None or alias.lower() == table.lower():
                    for c, t in columns.items():
                        if c.lower() == column.lower():
                            return t
            scope = scope.outer
        return None

    def json_alias(self, column: str, table: str | None) -> str | None:
        scope: Scope | None = self
        while scope is not None:
            for alias in scope.json:
                if (table or alias).lower() == alias.lower() and (table or not any(column.lower() in map(str.lower, c) for c in scope.tables.values())):
                    return alias
            scope = scope.outer
        return None


@dataclasses.dataclass
class Query:
    sql: str
    columns: list[tuple[str, str | None]]
    #: Of a plain SELECT, what it shows.
    items: list = dataclasses.field(default_factory=list)


#: A recursive UNION that Spark cannot run: name, column names, first query, step.
@dataclasses.dataclass
class Fixpoint:
    name: str
    columns: list[str]
    base: str
    step: str


@dataclasses.dataclass
class Exclusion:
    """A window with EXCLUDE: what goes, its partition, order and frame (unit, start, end), and the whole window's text."""

    kind: str
    partition: str
    order: str
    peers: str
    unit: str
    start: str
    end: str
    whole: str


_STOP = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "ON", "USING", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "AS", "THEN", "WHEN", "ELSE", "END", "AND", "OR", "ASC", "DESC", "NULLS", "BETWEEN", "IN", "IS", "LIKE", "GLOB", "NOT", "ESCAPE", "COLLATE", "FILTER", "OVER", "SET", "VALUES", "RETURNING", "DO", "ISNULL", "NOTNULL", "REGEXP", "MATCH", "SELECT"}
_COMPARE = {"=": "=", "==": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
_COLLATIONS = {"BINARY": "UTF8_BINARY", "NOCASE": "UTF8_LCASE", "RTRIM": "UTF8_BINARY_RTRIM"}


class Parser:
    def __init__(self, text: str, catalog: Callable[[str], Types | None], counters: dict[str, int] | None = None):
        self.text, self.toks, self.at = text, tokens(text), 0
        self.catalog = catalog
        self.ctes: dict[str, Types] = {}
        self.fixpoints: list[Fixpoint] = []
        self.uses_edit = False
        #: What changes() and its kin are; None where no database stands behind the text.
        self.counters = counters
        #: In a condition that rows are filtered by; references so far to columns of an outer query.
        self.filtering, self.outer_refs = False, 0
        #: GROUPS frames of the query being read: (column, partition, order); the exclusion of the window read last.
        self.ranked: list[tuple[str, str, str]] = []
        self.exclusion: Exclusion | None = None
        self.last_scope: Scope | None = None
        #: Where names without a table belong, if more than one table in sight has them.
        self.bare_table: str | None = None
        self.aggregated = False
        self.extremes: list[str] = []

    # Tokens.

    def peek(self, k: int = 0) -> Token | None:
        return self.toks[self.at + k] if self.at + k < len(self.toks) else None

    def is_(self, *words: str) -> bool:
        t = self.peek()
        return t is not None and t.is_(*words)

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> Token:
        t = self.peek()
        if t is None or not t.is_(*words):
            raise DialectError(f"near {t.value if t else 'the end'!r}: {' or '.join(words)} expected")
        self.at += 1
        return t

    def name(self) -> str:
        t = self.peek()
        if t is None or t.kind not in ("word", "name", "text"):
            raise DialectError(f"near {t.value if t else 'the end'!r}: a name expected")
        self.at += 1
        return unquoted(t) if t.kind != "word" else t.value

    def done(self) -> bool:
        return self.peek() is None

    def skip_to(self, *words: str) -> None:
        """To the next of these words at this depth, or the end of it."""
        depth = 0
        while (t := self.peek()) is not None:
            if depth == 0 and (t.is_(*words) or t.is_(")", ";")):
                return
            depth += t.is_("(") - t.is_(")")
            self.at += 1

    # Queries.

    def query(self, outer: Scope | None = None) -> Query:
        head = self.with_(outer) if self.is_("WITH") else ""
        body = self.compound(outer)
        tail = ""
        if self.take("ORDER"):
            self.need("BY")
            tail += " ORDER BY " + self.order_terms(body_scope(body, self.last_scope))
        if self.take("LIMIT"):
            tail += self.limit(outer)
        return Query(head + body.sql + tail, body.columns)

    def limit(self, outer: Scope | None) -> str:
        first = self.expr(Scope(outer=outer))
        second, skip = None, None
        if self.take("OFFSET"):
            skip = self.expr(Scope(outer=outer))
        elif self.take(","):
            second = self.expr(Scope(outer=outer))
            first, skip = second, first
        told = "" if _negative(first) else f" LIMIT {first.sql}"
        return told + (f" OFFSET {skip.sql}" if skip is not None and not _negative(skip) and skip.literal != 0 else "")

    def with_(self, outer: Scope | None) -> str:
        self.need("WITH")
        recursive, parts, levels = self.take("RECURSIVE"), [], False
        while True:
            name, columns = self.name(), []
            if self.take("("):
                columns.append(self.name())
                while self.take(","):
                    columns.append(self.name())
                self.need(")")
            self.need("AS")
            if self.take("NOT"):
                self.need("MATERIALIZED")
            else:
                self.take("MATERIALIZED")
            self.need("(")
            start, recursion = self.at, recursive and self.refers_to(name)
            if recursion and (made := self.counter(name)) is not None:
                self.ctes[name.lower()] = {(columns or ["x"])[0]: "int"}
                parts.append(f"{name_sql(name)}({name_sql((columns or ['x'])[0])}) AS ({made})")
                self.need(")")
            elif recursion:
                self.at = start
                base = self.core(outer)
                self.ctes[name.lower()] = dict(zip(columns or [c for c, _ in base.columns], [t for _, t in base.columns], strict=False))
                self.need("UNION")
                everything = self.take("ALL")
                step = self.core(outer)
                if self.take("LIMIT"):
                    raise DialectError("LIMIT inside a recursive query is not supported")
                self.need(")")
                listed = columns or [c for c, _ in base.columns]
                if everything:
                    levels = True
                    wide = {"int": "BIGINT", "real": "DOUBLE", "text": "STRING"}
                    kinds = [wide.get(t if t == u else wider([Value("", t), Value("", u)])) for (_, t), (_, u) in zip(base.columns, step.columns, strict=True)]
                    first = f"SELECT {', '.join(f'CAST({name_sql(c)} AS {k}) AS {name_sql(c)}' if k else name_sql(c) for c, k in zip(listed, kinds, strict=True))} FROM ({base.sql}) AS _first({', '.join(map(name_sql, listed))})"
                    parts.append(f"{name_sql(name)}({', '.join(map(name_sql, listed))}) MAX RECURSION LEVEL 10000 AS ({first} UNION ALL {self.cast_items(step, kinds)})")
                else:
                    self.fixpoints.append(Fixpoint(name, listed, base.sql, step.sql))
            else:
                q = self.query(outer)
                self.need(")")
                listed = columns or [c for c, _ in q.columns]
                self.ctes[name.lower()] = dict(zip(listed, [t for _, t in q.columns], strict=False))
                parts.append(f"{name_sql(name)}{'(' + ', '.join(map(name_sql, columns)) + ')' if columns else ''} AS ({q.sql})")
            if not self.take(","):
                break
        if not parts:
            return ""
        return f"WITH {'RECURSIVE ' if levels else ''}{', '.join(parts)} "

    def cast_items(self, step: Query, kinds: list[str | None]) -> str:
        """The step of a recursion with its columns of the types that the first query's were brought to."""
        shown = ", ".join(f"{plain(v)} AS {name_sql(n)}" for n, v in step.items)
        cast = ", ".join(f"CAST({plain(v)} AS {k}) AS {name_sql(n)}" if k else f"{plain(v)} AS {name_sql(n)}" for (n, v), k in zip(step.items, kinds, strict=True))
        return step.sql.replace(shown, cast, 1) if step.items else step.sql

    def refers_to(self, name: str) -> bool:
        depth, k = 0, 0
        while (t := self.peek(k)) is not None:
            if depth == 0 and t.is_(")"):
                return False
            depth += t.is_("(") - t.is_(")")
            if t.kind in ("word", "name") and unquoted(t).lower() == name.lower() and k and self.peek(k - 1).is_("FROM", "JOIN", ","):
                return True
            k += 1
        return False

    def counter(self, name: str) -> str | None:
        """SELECT a UNION ALL SELECT x + s FROM name WHERE x < b, as a range; None if it is anything else."""
        told = []
        k = 0
        while (t := self.peek(k)) is not None and not t.is_(")") and k < 20:
            told.append(t)
            k += 1
        shape = " ".join("N" if t.kind == "number" else "C" if t.kind == "word" and t.value.upper() not in ("SELECT", "VALUES", "UNION", "ALL", "FROM", "WHERE") and t.value.lower() != name.lower() else t.value.upper() for t in told)
        if shape not in (f"SELECT N UNION ALL SELECT C + N FROM {name.upper()} WHERE C < N", f"SELECT N UNION ALL SELECT C + N FROM {name.upper()} WHERE C <= N"):
            return None
        first, step, last = int(told[1].value), int(told[7].value), int(told[-1].value)
        self.at += k
        if step <= 0:
            return None
        end = last if told[-2].value == "<" else last + 1
        # The step is taken from every value below the bound.
        stop = first + step * max(0, -(-(end - first) // step))
        return f"SELECT id FROM range({first}, {stop + 1}, {step})"

    def compound(self, outer: Scope | None) -> Query:
        """Set operations bind equally and from the left."""
        left = self.core(outer)
        self.compounded = False
        while self.is_("UNION", "INTERSECT", "EXCEPT"):
            op = self.need("UNION", "INTERSECT", "EXCEPT").value.upper()
            if op == "UNION" and self.take("ALL"):
                op = "UNION ALL"
            right = self.core(outer)
            columns = [(c, wider([Value("", a), Value("", b)])) for (c, a), (_, b) in zip(left.columns, right.columns, strict=False)]
            left = Query(f"({left.sql}) {op} ({right.sql})", columns)
            self.last_scope = None
        return left

    def core(self, outer: Scope | None) -> Query:
        if self.take("VALUES"):
            return self.values(outer)
        if self.take("("):
            q = self.query(outer)
            self.need(")")
            return Query(f"({q.sql})", q.columns)
        self.need("SELECT")
        distinct = "DISTINCT " if self.take("DISTINCT") else ""
        self.take("ALL")
        items_at = self.at
        scope = Scope(outer=outer)
        self.skip_to("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "ON", "RETURNING")
        source = ""
        if self.take("FROM"):
            source = " FROM " + self.from_(scope)
        after = self.at
        self.at = items_at
        held = self.aggregated, self.extremes, self.filtering, self.ranked
        self.aggregated, self.extremes, self.filtering, self.ranked = False, [], False, []
        items = self.items(scope)
        aggregated, extremes = self.aggregated, self.extremes
        self.at = after
        self.filtering = True
        where = f" WHERE {truth(self.expr(scope))}" if self.take("WHERE") else ""
        self.filtering = False
        keys, group, having = [], "", ""
        if self.take("GROUP"):
            self.need("BY")
            keys = [self.expr(scope)]
            while self.take(","):
                keys.append(self.expr(scope))
            group = " GROUP BY " + ", ".join(plain(k) for k in keys)
        if self.take("HAVING"):
            having = f" HAVING {truth(self.expr(scope))}"
        window = ""
        if self.take("WINDOW"):
            parts = []
            while True:
                n = self.name()
                self.need("AS")
                parts.append(f"{name_sql(n)} AS {self.window_body(scope)}")
                if not self.take(","):
                    break
            window = " WINDOW " + ", ".join(parts)
        if aggregated or keys:
            items = self.bare(items, keys, extremes)
        if self.ranked:
            if len(scope.tables) != 1 or keys or aggregated:
                raise DialectError("a GROUPS frame needs one table or subquery in FROM, and no GROUP BY")
            # Peer groups are numbered below, where the rows that WHERE keeps are known.
            inner = ", ".join(f"dense_rank() OVER ({' '.join(x for x in (part, order) if x)}) AS {name}" for name, part, order in self.ranked)
            source, where = f" FROM (SELECT *, {inner}{source}{where}) AS {name_sql(next(iter(scope.tables)))}", ""
            hidden = f" EXCEPT ({', '.join(name for name, _, _ in self.ranked)})"
            items = [(n, Value(v.sql + hidden, column=v.column)) if n == "*" else (n, v) for n, v in items]
        self.aggregated, self.extremes, self.filtering, self.ranked = held
        self.last_scope = scope
        shown = ", ".join(f"{plain(v)} AS {name_sql(n)}" if n != "*" else v.sql for n, v in items)
        columns = []
        for n, v in items:
            if n == "*":
                table = v.column
                columns += [(c, t) for alias, cols in scope.tables.items() if table is None or alias.lower() == table.lower() for c, t in cols.items()]
            else:
                columns.append((n, "int" if v.type == "bool" else v.type))
        return Query(f"SELECT {distinct}{shown}{source}{where}{group}{having}{window}", columns, [] if any(n == "*" for n, _ in items) else items)

    def bare(self, items: list, keys: list[Value], extremes: list[str]) -> list:
        """Plain columns that are not grouped by take the values of the row with the one min or max, or any row's."""
        grouped = {k.sql.split(".")[-1].lower() for k in keys}
        ordinals = {k.literal for k in keys if isinstance(k.literal, int)}
        out = []
        for i, (n, v) in enumerate(items):
            if v.column and n != "*" and v.sql.split(".")[-1].lower() not in grouped and name_sql(n).lower() not in grouped and i + 1 not in ordinals:
                told = extremes[0].replace("?", v.sql) if len(extremes) == 1 else f"any_value({v.sql})"
                v = Value(told, v.type)
            out.append((n, v))
        return out

    def values(self, outer: Scope | None) -> Query:
        rows = []
        while True:
            self.need("(")
            row = [self.expr(Scope(outer=outer))]
            while self.take(","):
                row.append(self.expr(Scope(outer=outer)))
            self.need(")")
            rows.append(row)
            if not self.take(","):
                break
        columns = [(f"column{i + 1}", wider([r[i] for r in rows])) for i in range(len(rows[0]))]
        self.last_scope = None
        if any(v.literal is None and v.type not in ("null", "blob") for row in rows for v in row):
            # An inline table takes constants only.
            named = lambda row: ", ".join(f"{plain(v)} AS {c}" for v, (c, _) in zip(row, columns, strict=True))
            return Query(" UNION ALL ".join(f"SELECT {named(row)}" for row in rows), columns)
        told = ", ".join(f"({', '.join(plain(v) for v in row)})" for row in rows)
        return Query(f"SELECT * FROM VALUES {told} AS v({', '.join(c for c, _ in columns)})", columns)

    def items(self, scope: Scope) -> list[tuple[str, Value]]:
        out = []
        while True:
            t = self.peek()
            if self.take("*"):
                out.append(("*", Value("*")))
            elif t is not None and t.kind in ("word", "name") and self.peek(1) is not None and self.peek(1).is_(".") and self.peek(2) is not None and self.peek(2).is_("*"):
                table = self.name()
                self.at += 2
                out.append(("*", Value(f"{name_sql(table)}.*", column=table)))
            else:
                start = self.at
                v = self.expr(scope)
                told = self.text[self.toks[start].start : self.toks[self.at - 1].end]
                if self.take("AS"):
                    n = self.name()
                elif (p := self.peek()) is not None and (p.kind in ("name", "text") or p.kind == "word" and p.value.upper() not in _STOP):
                    n = self.name()
                else:
                    n = v.column or told
                out.append((n, v))
            if not self.take(","):
                return out

    def from_(self, scope: Scope) -> str:
        out = self.source(scope)
        while True:
            if self.take(","):
                out += " CROSS JOIN " + self.source(scope, joined=True)
                continue
            if not self.is_("NATURAL", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "JOIN"):
                return out
            words = []
            while not self.is_("JOIN"):
                words.append(self.need("NATURAL", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "OUTER").value.upper())
            self.need("JOIN")
            right = self.source(scope, joined=True)
            tail = ""
            if self.take("ON"):
                tail = f" ON {truth(self.expr(scope))}"
            elif self.take("USING"):
                self.need("(")
                columns = [self.name()]
                while self.take(","):
                    columns.append(self.name())
                self.need(")")
                tail = f" USING ({', '.join(map(name_sql, columns))})"
            elif not words or words == ["INNER"]:
                words = ["CROSS"]
            out += f" {' '.join(words)}{' ' if words else ''}JOIN {right}{tail}"

    def source(self, scope: Scope, joined: bool = False) -> str:
        if self.take("("):
            if self.is_("SELECT", "VALUES", "WITH", "("):
                held = self.last_scope if hasattr(self, "last_scope") else None
                q = self.query(scope.outer)
                self.last_scope = held
                self.need(")")
                alias = self.alias() or f"_q{self.at}"
                scope.tables[alias] = dict(q.columns)
                return f"({q.sql}) AS {name_sql(alias)}"
            inner = self.from_(scope)
            self.need(")")
            return f"({inner})"
        name = self.name()
        if self.take("."):
            name = self.name()
        if self.take("("):
            args = [] if self.is_(")") else [self.expr(scope)]
            while self.take(","):
                args.append(self.expr(scope))
            self.need(")")
            alias = self.alias() or name
            if name.lower() in ("json_each", "json_tree"):
                j = as_text(args[0])
                if name.lower() == "json_tree":
                    self.uses_edit = True
                    path = as_text(args[1]) if len(args) > 1 else "'$'"
                    scope.tables[alias] = dict(jsons.TREE)
                    told = f"(SELECT inline(td_json_tree({j}, {path})))"
                    return f"{'LATERAL ' if joined else ''}{told} AS {name_sql(alias)}"
                if len(args) > 1:
                    j = f"get_json_object({j}, {as_text(args[1])})"
                scope.json.add(alias)
                scope.tables[alias] = {}
                return f"{'LATERAL ' if joined else ''}variant_explode(try_parse_json({j})) AS {name_sql(alias)}"
            if name.lower() == "generate_series":
                a, b = as_int(args[0]), as_int(args[1])
                step = as_int(args[2]) if len(args) > 2 else "1L"
                scope.tables[alias] = {"value": "int"}
                return f"(SELECT explode(sequence({a}, {b}, {step})) AS value) AS {name_sql(alias)}"
            raise DialectError(f"no such table-valued function: {name}")
        if self.take("INDEXED"):
            self.need("BY")
            self.name()
        elif self.take("NOT"):
            self.need("INDEXED")
        alias = self.alias()
        columns = self.ctes.get(name.lower())
        if columns is None:
            columns = self.catalog(name)
        scope.tables[alias or name] = columns or {}
        return name_sql(name) + (f" AS {name_sql(alias)}" if alias else "")

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.name()
        t = self.peek()
        if t is not None and (t.kind == "name" or t.kind == "word" and t.value.upper() not in _STOP | {"INDEXED"}):
            return self.name()
        return None

    def order_terms(self, scope: Scope) -> str:
        parts = []
        while True:
            v = self.expr(scope)
            told = plain(v)
            if self.take("DESC"):
                told += " DESC"
            else:
                self.take("ASC")
            if self.take("NULLS"):
                told += f" NULLS {self.need('FIRST', 'LAST').value.upper()}"
            parts.append(told)
            if not self.take(","):
                return ", ".join(parts)

    def window_body(self, scope: Scope) -> str:
        self.need("(")
        self.exclusion = None
        base, partition, order, terms = "", "", "", []
        t = self.peek()
        if t.kind in ("word", "name") and not t.is_("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS"):
            base = name_sql(self.name())
        if self.take("PARTITION"):
            self.need("BY")
            keys = [plain(self.expr(scope))]
            while self.take(","):
                keys.append(plain(self.expr(scope)))
            partition = "PARTITION BY " + ", ".join(keys)
        if self.take("ORDER"):
            self.need("BY")
            at = self.at
            order = "ORDER BY " + self.order_terms(scope)
            after, self.at = self.at, at
            terms = self.bare_terms(scope)
            self.at = after
        unit, start, end, exclude = "", "", "", ""
        if self.is_("ROWS", "RANGE", "GROUPS"):
            unit = self.need("ROWS", "RANGE", "GROUPS").value.upper()
            if self.take("BETWEEN"):
                start = self.bound(scope)
                self.need("AND")
                end = self.bound(scope)
            else:
                start, end = self.bound(scope), "CURRENT ROW"
            if self.take("EXCLUDE"):
                if self.take("NO"):
                    self.need("OTHERS")
                elif self.take("CURRENT"):
                    self.need("ROW")
                    exclude = "ROW"
                else:
                    exclude = self.need("GROUP", "TIES").value.upper()
        self.need(")")
        if base and (unit == "GROUPS" or exclude):
            raise DialectError("a window that builds on another one takes no GROUPS frame and no EXCLUDE")
        plain_ends = all(x.startswith("UNBOUNDED") or x == "CURRENT ROW" for x in (start, end))
        if unit == "GROUPS" or exclude in ("GROUP", "TIES") and plain_ends and (unit == "RANGE" or "CURRENT ROW" not in (start, end)):
            # A frame of peer groups is a RANGE frame over their numbers.
            if not order:
                raise DialectError("GROUPS mode requires an ORDER BY clause")
            name = f"_td_g{len(self.ranked)}"
            self.ranked.append((name, partition, order))
            unit, order = "RANGE", f"ORDER BY {name}"
            terms = [name]
        frame = f"{unit} BETWEEN {start} AND {end}" if unit else ""
        whole = f"({' '.join(x for x in (base, partition, order, frame) if x)})"
        if exclude:
            peers = ", ".join([partition.removeprefix("PARTITION BY ")] * bool(partition) + terms)
            self.exclusion = Exclusion(exclude, partition, order, f"(PARTITION BY {peers})" if peers else "()", unit, start, end, whole)
        return whole

    def bare_terms(self, scope: Scope) -> list[str]:
        """ORDER BY terms without their directions."""
        out = []
        while True:
            out.append(plain(self.expr(scope)))
            self.take("ASC", "DESC")
            if self.take("NULLS"):
                self.need("FIRST", "LAST")
            if not self.take(","):
                return out

    def bound(self, scope: Scope) -> str:
        if self.take("UNBOUNDED"):
            return f"UNBOUNDED {self.need('PRECEDING', 'FOLLOWING').value.upper()}"
        if self.take("CURRENT"):
            self.need("ROW")
            return "CURRENT ROW"
        return f"{self.expr(scope, 20).sql} {self.need('PRECEDING', 'FOLLOWING').value.upper()}"

    # Expressions, by binding strength.

    def expr(self, scope: Scope, least: int = 0) -> Value:
        left = self.prefix(scope)
        while (t := self.peek()) is not None:
            made = self.infix(scope, left, t, least)
            if made is None:
                return left
            left = made
        return left

    def infix(self, scope: Scope, left: Value, t: Token, least: int) -> Value | None:
        word = t.value.upper() if t.kind in ("op", "word") else ""
        strength = {"OR": 1, "AND": 2}.get(word) or (4 if word in ("=", "==", "<>", "!=", "IS", "IN", "LIKE", "GLOB", "REGEXP", "MATCH", "BETWEEN", "ISNULL", "NOTNULL") or word == "NOT" and self.peek(1) is not None and self.peek(1).is_("IN", "LIKE", "GLOB", "REGEXP", "MATCH", "BETWEEN", "NULL") else 5 if word in ("<", "<=", ">", ">=") else 6 if word in ("&", "|", "<<", ">>") else 7 if word in ("+", "-") else 8 if word in ("*", "/", "%") else 9 if word in ("||", "->", "->>") else 10 if word == "COLLATE" else 0)
        if not strength or strength <= least:
            return None
        self.at += 1
        if word in ("OR", "AND"):
            return Value(f"({truth(left)} {word} {truth(self.expr(scope, strength))})", "bool")
        if word == "COLLATE":
            c = self.name().upper()
            if c not in _COLLATIONS:
                raise DialectError(f"no such collation sequence: {c}")
            return Value(f"({as_text(left)} COLLATE {_COLLATIONS[c]})", "text")
        if word in ("ISNULL", "NOTNULL"):
            return Value(f"({left.sql} IS {'NOT ' * (word == 'NOTNULL')}NULL)", "bool")
        inverse = False
        if word == "NOT":
            inverse, word = True, self.peek().value.upper()
            self.at += 1
            if word == "NULL":
                return Value(f"({left.sql} IS NOT NULL)", "bool")
        no = "NOT " if inverse else ""
        if word == "IS":
            inverse = self.take("NOT")
            if self.take("DISTINCT"):
                self.need("FROM")
                inverse = not inverse
            right = self.expr(scope, 4)
            if right.type == "null":
                return Value(f"({left.sql} IS {'NOT ' * inverse}NULL)", "bool")
            a, b = _compared(left, right)
            return Value(f"({'NOT ' * inverse}({a} <=> {b}))", "bool")
        if word == "BETWEEN":
            low = self.expr(scope, 5)
            self.need("AND")
            high = self.expr(scope, 5)
            a, b = _compared(left, low)
            return Value(f"({a} {no}BETWEEN {b} AND {_compared(left, high)[1]})", "bool")
        if word == "IN":
            return Value(f"({self.in_(scope, left, no)})", "bool")
        if word in ("LIKE", "GLOB", "REGEXP", "MATCH"):
            right = self.expr(scope, 4)
            if word == "LIKE":
                escape = self.expr(scope, 4) if self.take("ESCAPE") else None
                return Value(f"({lowered(left)} {no}LIKE {lowered(right)}{_escape(right, escape)})", "bool")
            if word == "MATCH":
                return self.match(scope, left, right, no)
            pattern = scalars.glob_pattern(right) if word == "GLOB" else as_text(right)
            return Value(f"({no}({as_text(left)} RLIKE {pattern}))", "bool")
        right = self.expr(scope, strength)
        if word in _COMPARE:
            a, b = _compared(left, right)
            return Value(f"({a} {_COMPARE[word]} {b})", "bool")
        if word == "||":
            return Value(f"({as_text(left)} || {as_text(right)})", "text")
        if word in ("->", "->>"):
            return jsons.arrow(left, right, word == "->>")
        return _arithmetic(word, left, right)

    def match(self, scope: Scope, left: Value, right: Value, no: str) -> Value:
        """Full-text search in a column, or in all text columns of a table that is named as one."""
        from tidemark.operators import fts

        if not isinstance(right.literal, str):
            raise DialectError("MATCH needs a text literal as its query")
        table = next((cols for alias, cols in scope.tables.items() if left.column and alias.lower() == left.column.lower()), None)
        if table is not None and not any(c.lower() == left.column.lower() for c in table):
            alias = next(a for a in scope.tables if a.lower() == left.column.lower())
            told = ", ".join(f"{name_sql(alias)}.{name_sql(c)}" for c, t in table.items() if t == "text")
            text = f"concat_ws(' ', {told})"
        else:
            text = as_text(left)
        return Value(f"({no}{fts.condition(text, right.literal)})", "bool")

    def in_(self, scope: Scope, left: Value, no: str) -> str:
        self.need("(")
        if self.is_("SELECT", "WITH", "VALUES"):
            before, filtering, self.filtering = self.outer_refs, self.filtering, False
            q = self.query(scope)
            self.filtering = filtering
            self.need(")")
            if no and filtering and left.type != "row" and self.outer_refs == before:
                # Spark's own plan for NOT IN broadcasts the subquery, however large. This is an anti join, and two
                # checks that do not depend on the row: no null on the other side, or nothing at all there.
                x, k = plain(left), self.at
                other = lambda test: f"NOT EXISTS (SELECT 1 FROM ({q.sql}) AS _n{k}(_c{k}){test})"
                return f"{other(f' WHERE _c{k} = {x}')} AND ({x} IS NOT NULL AND {other(f' WHERE _c{k} IS NULL')} OR {other('')})"
            return f"{plain(left)} {no}IN ({q.sql})"
        if self.take(")"):
            return "true" if no else "false"
        listed = [self.expr(scope)]
        while self.take(","):
            listed.append(self.expr(scope))
        self.need(")")
        return f"{plain(left)} {no}IN ({', '.join(_compared(left, v)[1] for v in listed)})"

    def prefix(self, scope: Scope) -> Value:
        t = self.peek()
        if t is None:
            raise DialectError("incomplete input")
        self.at += 1
        if t.kind == "number":
            return _number(t.value)
        if t.kind == "text":
            return Value(quoted(unquoted(t)), "text", unquoted(t))
        if t.kind == "blob":
            return Value(f"X{t.value[1:]}", "blob")
        if t.kind == "param":
            return Value(t.value if t.value[0] in ":?" else ":" + t.value[1:])
        if t.is_("-", "+", "~"):
            v = self.expr(scope, 10)
            if t.value == "+":
                return v
            number = plain(v) if v.type in ("int", "real", "bool") else as_real(v) if t.value == "-" else as_int(v)
            literal = -v.literal if t.value == "-" and isinstance(v.literal, (int, float)) else None
            return Value(f"({t.value}{number})", "int" if t.value == "~" or v.type in ("int", "bool") else "real", literal)
        if t.is_("NOT"):
            if self.is_("EXISTS"):
                self.at += 1
                return Value(f"(NOT EXISTS ({self.inside(scope)}))", "bool")
            return Value(f"(NOT {truth(self.expr(scope, 3))})", "bool")
        if t.is_("EXISTS"):
            return Value(f"(EXISTS ({self.inside(scope)}))", "bool")
        if t.is_("("):
            if self.is_("SELECT", "WITH", "VALUES"):
                q = self.query(scope)
                self.need(")")
                told = q.sql if " LIMIT " in q.sql or _single(q.sql) else f"SELECT * FROM ({q.sql}) LIMIT 1"
                return Value(f"({told})", q.columns[0][1] if q.columns else None)
            v = self.expr(scope)
            if self.is_(","):
                row = [v]
                while self.take(","):
                    row.append(self.expr(scope))
                self.need(")")
                # Both sides of a comparison need the same field names and types.
                told = ", ".join(f"'c{k}', {as_int(x) if x.type in ('int', 'bool') else plain(x)}" for k, x in enumerate(row))
                return Value(f"named_struct({told})", "row")
            self.need(")")
            return Value(f"({v.sql})", v.type, v.literal)
        if t.is_("CASE"):
            return self.case(scope)
        if t.is_("CAST") and self.is_("("):
            return self.cast(scope)
        if t.is_("NULL"):
            return Value("NULL", "null")
        if t.is_("TRUE", "FALSE"):
            return Value("1" if t.is_("TRUE") else "0", "int", int(t.is_("TRUE")))
        if t.is_("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP"):
            return datetimes.FUNCTIONS[t.value.lower()]([])
        if t.kind in ("word", "name"):
            name = unquoted(t) if t.kind == "name" else t.value
            if t.kind == "word" and self.is_("("):
                return self.call(scope, name.lower())
            if t.kind == "word" and t.value.upper() in _STOP:
                raise DialectError(f"near {t.value!r}: syntax error")
            if self.is_(".") and self.peek(1) is not None:
                self.at += 1
                return self.column(scope, self.name(), name)
            return self.column(scope, name, None)
        raise DialectError(f"near {t.value!r}: syntax error")

    def column(self, scope: Scope, name: str, table: str | None) -> Value:
        if (alias := scope.json_alias(name, table)) is not None and name.lower() in ("key", "value", "type", "atom", "id"):
            a = name_sql(alias)
            told = {"key": f"coalesce({a}.key, CAST({a}.pos AS STRING))", "value": f"CAST({a}.value AS STRING)", "atom": f"CAST({a}.value AS STRING)", "id": f"{a}.pos", "type": f"CASE WHEN schema_of_variant({a}.value) LIKE 'OBJECT%' THEN 'object' WHEN schema_of_variant({a}.value) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant({a}.value) = 'STRING' THEN 'text' WHEN schema_of_variant({a}.value) = 'BIGINT' THEN 'integer' WHEN schema_of_variant({a}.value) = 'VOID' THEN 'null' ELSE 'real' END"}
            return Value(told[name.lower()], "int" if name.lower() == "id" else "text")
        if name.lower() == "rowid" and scope.type_of(name, table) is None:
            name = "_rowid"
        self.outer_refs += self.is_outer(scope, name, table)
        table = table or self.bare_table
        told = name_sql(name) if table is None else f"{name_sql(table)}.{name_sql(name)}"
        return Value(told, scope.type_of(name, table), column=name)

    def is_outer(self, scope: Scope, name: str, table: str | None) -> bool:
        """Whether a column surely or possibly belongs to an outer query."""
        if scope.outer is None:
            return False
        if table is not None:
            return not any(alias.lower() == table.lower() for alias in scope.tables)
        return not any(c.lower() == name.lower() for cols in scope.tables.values() for c in cols) and not any(not cols for cols in scope.tables.values())

    def inside(self, scope: Scope) -> str:
        self.need("(")
        q = self.query(scope)
        self.need(")")
        return q.sql

    def case(self, scope: Scope) -> Value:
        base = None if self.is_("WHEN") else self.expr(scope)
        parts, results = [], []
        while self.take("WHEN"):
            test = self.expr(scope)
            self.need("THEN")
            result = self.expr(scope)
            results.append(result)
            parts.append(f"WHEN {truth(test) if base is None else _compared(base, test)[1]} THEN {plain(result)}")
        if self.take("ELSE"):
            other = self.expr(scope)
            results.append(other)
            parts.append(f"ELSE {plain(other)}")
        self.need("END")
        return Value(f"CASE {'' if base is None else plain(base) + ' '}{' '.join(parts)} END", wider(results))

    def cast(self, scope: Scope) -> Value:
        self.need("(")
        v = self.expr(scope)
        self.need("AS")
        words = []
        while not self.is_(")"):
            if self.take("("):
                self.skip_to(")")
                self.need(")")
            else:
                words.append(self.name().upper())
        self.need(")")
        kind = affinity(" ".join(words))
        told = {"int": as_int, "real": as_real, "numeric": as_real, "text": as_text, "blob": lambda x: f"CAST({as_text(x)} AS BINARY)"}[kind](v)
        if v.type == "null":
            told = f"CAST(NULL AS {({'int': 'BIGINT', 'real': 'DOUBLE', 'numeric': 'DOUBLE', 'text': 'STRING', 'blob': 'BINARY'})[kind]})"
        return Value(told, "real" if kind == "numeric" else kind)

    def call(self, scope: Scope, name: str) -> Value:
        self.need("(")
        distinct, star, order, args = self.take("DISTINCT"), False, None, []
        agg = name in aggregates.NAMES
        if self.take("*"):
            star = True
        elif not self.is_(")"):
            args.append(self.expr(scope))
            while self.take(","):
                args.append(self.expr(scope))
            if self.take("ORDER"):
                self.need("BY")
                order = self.order_terms(scope)
        self.need(")")
        condition, over, self.exclusion = None, None, None
        if self.counters is not None and name in self.counters and not args:
            return Value(f"{self.counters[name]}L", "int", self.counters[name])
        if self.take("FILTER"):
            self.need("(")
            self.need("WHERE")
            condition = self.expr(scope)
            self.need(")")
        if self.take("OVER"):
            over = self.window_body(scope) if self.is_("(") else name_sql(self.name())
        exclusion, self.exclusion = self.exclusion if over is not None else None, None
        if exclusion is not None:
            if condition is not None:
                args = [Value(f"CASE WHEN {truth(condition)} THEN {'1' if star or not args else plain(args[0])} END", "int" if star or not args else args[0].type), *args[1:]]
            return aggregates.excluding(name, args, exclusion)
        if over is not None and name in aggregates.WINDOW_NAMES:
            return aggregates.window(name, args, over)
        if agg and (name not in ("min", "max") or len(args) == 1 or over is not None):
            if over is None:
                self.aggregated = True
                if name in ("min", "max"):
                    self.extremes.append(f"IF({name}({plain(args[0])}) IS NULL, any_value(?), {name}_by(?, {plain(args[0])}))")
            return aggregates.aggregate(name, args, star, distinct, order, condition, over)
        for family in (scalars.FUNCTIONS, datetimes.FUNCTIONS, jsons.FUNCTIONS):
            if name in family:
                made = family[name](args)
                self.uses_edit |= "td_json_edit(" in made.sql
                return made
        raise DialectError(f"no such function: {name}")


def affinity(declared: str) -> str:
    """The type that a declared type name stands for."""
    d = declared.upper()
    if "INT" in d:
        return "int"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "text"
    if "BLOB" in d or not d:
        return "blob"
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return "real"
    return "numeric"


def body_scope(body: Query, inner: Scope | None) -> Scope:
    """ORDER BY sees the result's columns first, then those of the tables."""
    made = Scope(tables={"": {c: t for c, t in body.columns if c != "*"}})
    if inner is not None:
        made.tables |= inner.tables
        made.json = inner.json
        made.outer = inner.outer
    return made


def _single(sql: str) -> bool:
    """A query that surely has one row: one aggregate without grouping, or no table."""
    return " GROUP BY " not in sql and any(sql.startswith(f"SELECT {f}(") for f in ("count", "sum", "avg", "min", "max", "coalesce(sum")) and " UNION " not in sql or " FROM " not in sql


def _negative(v: Value) -> bool:
    return isinstance(v.literal, (int, float)) and v.literal < 0


def _number(text: str) -> Value:
    if text[:2].lower() == "0x":
        return Value(str(int(text, 16)), "int", int(text, 16))
    if text.isdigit():
        n = int(text)
        return Value(text if n < 1 << 31 else text + "L" if n < 1 << 63 else text + "D", "int" if n < 1 << 63 else "real", n)
    return Value(f"{float(text)!r}D", "real", float(text))


def _whole(n: int) -> Value:
    if not -(1 << 63) <= n < 1 << 63:
        return Value(f"{float(n)!r}D", "real", float(n))
    told = str(n) if -(1 << 31) < n < 1 << 31 else f"{n}L" if n > -(1 << 63) else "(-9223372036854775807L - 1L)"
    return Value(f"({told})" if n < 0 else told, "int", n)


def _constant(v: Value) -> Value | None:
    return v if v.literal is not None and v.column is None else None


def _compared(a: Value, b: Value) -> tuple[str, str]:
    """Two sides of a comparison: truth values count as numbers. A number and a text: where one is a column, the other
    is brought to its type; where neither is, the number is the smaller, whatever the text says."""
    number, text = ("int", "real", "bool"), "text"
    for x, y, turned in ((a, b, False), (b, a, True)):
        if x.type == text and y.type in number:
            if x.column is None and y.column is None and x.literal is not None and y.literal is not None:
                # Two literals: numbers come before texts.
                return ("0", "1") if turned else ("1", "0")
            if x.column is not None and _constant(y):
                sides = plain(x), as_text(y) if y.type != "real" else plain(y)
                return sides[::-1] if turned else sides
    return plain(a), plain(b)


def _escape(pattern: Value, escape: Value | None) -> str:
    if escape is not None:
        return f" ESCAPE {escape.sql}"
    # Without ESCAPE no character is special; Spark would take the backslash.
    return "" if isinstance(pattern.literal, str) and "\\" not in pattern.literal else " ESCAPE '\\u0001'"


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    if op in ("&", "|", "<<", ">>"):
        x, y = as_int(a), as_int(b)
        if op in ("<<", ">>"):
            f = "shiftleft" if op == "<<" else "shiftright"
            return Value(f"{f}({x}, CAST({y} AS INT))", "int")
        return Value(f"({x} {op} {y})", "int")
    if op == "%":
        return Value(f"try_mod({as_int(a)}, {as_int(b)})", "int")
    whole = known([a, b], "int", "bool")
    if whole and op in ("+", "-", "*") and isinstance(a.literal, int) and isinstance(b.literal, int):
        # Constants are added here: a result beyond 64 bits is real.
        n = {"+": a.literal + b.literal, "-": a.literal - b.literal, "*": a.literal * b.literal}[op]
        return _whole(n)
    x, y = (plain(v) if v.type in ("int", "real", "bool") or v.type is None else as_real(v) if v.type != "null" else "CAST(NULL AS DOUBLE)" for v in (a, b))
    if op == "/":
        if whole:
            return Value(f"(CASE WHEN {y} = 0 THEN NULL ELSE {x} DIV {y} END)", "int")
        return Value(f"try_divide({x}, {y})", "real")
    return Value(f"({x} {op} {y})", "int" if whole else "real" if "real" in (a.type, b.type) or "text" in (a.type, b.type) else None)


@dataclasses.dataclass
class Translated:
    sql: str
    columns: list[tuple[str, str | None]]
    fixpoints: list[Fixpoint]
    uses_edit: bool


def translate(text: str, catalog: Callable[[str], Types | None] = lambda name: None, counters: dict[str, int] | None = None) -> Translated:
    """A query as Spark SQL. catalog gives the column types of a table."""
    p = Parser(text, catalog, counters)
    q = p.query()
    p.take(";")
    if not p.done():
        raise DialectError(f"near {p.peek().value!r}: syntax error")
    return Translated(q.sql, q.columns, p.fixpoints, p.uses_edit)
