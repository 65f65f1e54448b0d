"""Which files of a versioned table a statement's WHERE clause can need, told from the column ranges in the manifest.

Only what is sure is used: comparisons of a column with a literal that hold for every
row of the result. Whatever else the statement says is left to Spark.
"""

from __future__ import annotations

from .script import Token, tokens, unquoted

_ENDS = ("GROUP", "ORDER", "LIMIT", "HAVING", "WINDOW", "RETURNING", ";")
_OTHERS = ("JOIN", "UNION", "INTERSECT", "EXCEPT", "WITH", "VALUES", "NATURAL", "EXISTS")
_FLIPPED = {"=": "=", "==": "==", "<": ">", "<=": ">=", ">": "<", ">=": "<="}

Condition = tuple[str, str, object]


def conditions(text: str) -> tuple[str, list[Condition]] | None:
    """The one table that a SELECT, UPDATE or DELETE reads, and (column, comparison, value) that all its rows meet."""
    toks = tokens(text)
    if sum(t.is_("SELECT") for t in toks) > 1 or any(t.is_(*_OTHERS) for t in toks) or not toks:
        return None
    if toks[0].is_("UPDATE"):
        at = 1
        if any(t.is_("FROM") for t in toks):
            return None
    else:
        at = next((i for i, t in enumerate(toks) if t.is_("FROM")), -1) + 1
    if not at or at >= len(toks) or toks[at].kind not in ("word", "name"):
        return None
    table = unquoted(toks[at]) if toks[at].kind == "name" else toks[at].value
    where, depth = None, 0
    for i in range(at + 1, len(toks)):
        depth += toks[i].is_("(") - toks[i].is_(")")
        if depth == 0 and toks[i].is_("WHERE"):
            where = i
            break
        if depth == 0 and toks[i].is_(",") and not toks[0].is_("UPDATE"):
            return None
    if where is None or any(t.is_("CASE") for t in toks[where:]):
        return table, []
    parts, depth, between = [[]], 0, False
    for t in toks[where + 1 :]:
        if depth == 0 and t.is_(*_ENDS):
            break
        if depth == 0 and t.is_("OR"):
            return table, []
        if depth == 0 and t.is_("BETWEEN"):
            between = True
        if depth == 0 and t.is_("AND"):
            if not between:
                parts.append([])
                continue
            between = False
        depth += t.is_("(") - t.is_(")")
        parts[-1].append(t)
    return table, [c for part in parts for c in _one(part)]


def _column(part: list[Token]) -> str | None:
    if len(part) == 3 and part[1].is_("."):
        part = part[2:]
    if len(part) != 1 or part[0].kind not in ("word", "name"):
        return None
    return unquoted(part[0]) if part[0].kind == "name" else part[0].value


def _literal(part: list[Token]) -> object:
    sign = 1
    if len(part) == 2 and part[0].is_("-"):
        sign, part = -1, part[1:]
    if len(part) != 1:
        return None
    if part[0].kind == "number":
        told = part[0].value
        return sign * (int(told, 16) if told[:2].lower() == "0x" else int(told) if told.isdigit() else float(told))
    return unquoted(part[0]) if part[0].kind == "text" and sign == 1 else None


def _one(part: list[Token]) -> list[Condition]:
    at = next((i for i, t in enumerate(part) if t.is_(*_FLIPPED, "BETWEEN", "IN")), None)
    if at is None:
        return []
    op, left, right = part[at].value.upper(), part[:at], part[at + 1 :]
    column = _column(left)
    if op == "BETWEEN" and column:
        middle = next((i for i, t in enumerate(right) if t.is_("AND")), len(right))
        low, high = _literal(right[:middle]), _literal(right[middle + 1 :])
        return [(column, o, v) for o, v in ((">=", low), ("<=", high)) if v is not None]
    if op == "IN" and column and len(right) > 2 and right[0].is_("(") and right[-1].is_(")"):
        values, one = [], []
        for t in [*right[1:-1], None]:
            if t is None or t.is_(","):
                values.append(_literal(one))
                one = []
            else:
                one.append(t)
        return [(column, "IN", values)] if all(v is not None for v in values) else []
    if op not in _FLIPPED:
        return []
    if column and (value := _literal(right)) is not None:
        return [(column, op, value)]
    if (column := _column(right)) and (value := _literal(left)) is not None:
        return [(column, _FLIPPED[op], value)]
    return []


def may_hold(low, high, op: str, value) -> bool:
    """Whether a file whose column lies between low and high can have a row that meets the condition."""
    if op == "IN":
        return any(low <= v <= high for v in value)
    return {"=": low <= value <= high, "==": low <= value <= high, "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value}[op]


def files(t: dict, found: list[Condition]) -> list[str]:
    """The live files of a table that can hold a row that meets all conditions."""
    by_name = {c["name"].lower(): c for c in t["columns"]}
    usable = []
    for column, op, value in found:
        c = by_name.get(column.lower())
        if c is None and column.lower() in ("rowid", "_rowid", "oid"):
            c = {"id": "_rowid", "type": "int"}
        if c is None or c.get("collate") or c.get("generated"):
            continue
        values = value if op == "IN" else [value]
        kind = (int, float) if c["type"] in ("int", "real", "numeric") else str if c["type"] == "text" else ()
        if all(isinstance(v, kind) for v in values):
            usable.append((c["id"], op, value))
    out = []
    for f, told in sorted(t["files"].items()):
        ranges = told.get("ranges", {})
        # A file's renumbered row ids are not those that its range tells.
        if all(c not in ranges or c == "_rowid" and "shift" in told or may_hold(*ranges[c], op, value) for c, op, value in usable):
            out.append(f)
    return out
