"""Values: an expression's Spark SQL text with its static type.

Types are int, real, text, blob, bool, ts (a timestamp column), null, or None where unknown.
"""

from __future__ import annotations

import dataclasses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclasses.dataclass(frozen=True)
class Value:
    sql: str
    type: str | None = None
    #: Of a literal, its value; of a plain column, its name.
    literal: object = None
    column: str | None = None


def quoted(text: str) -> str:
    """A Spark string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def plain(v: Value) -> str:
    """The value with booleans as 1 and 0."""
    return f"CAST({v.sql} AS INT)" if v.type == "bool" else v.sql


def truth(v: Value) -> str:
    """The value as a condition: numbers other than 0 are true."""
    if v.type == "bool":
        return v.sql
    if v.type == "null":
        return "CAST(NULL AS BOOLEAN)"
    if v.type == "text":
        return f"({as_real(v)} <> 0)"
    return f"({v.sql} <> 0)"


def as_text(v: Value) -> str:
    return v.sql if v.type == "text" else f"CAST({plain(v)} AS STRING)"


def as_int(v: Value) -> str:
    """A lenient cast: the longest leading whole number of a text, else 0."""
    if v.type in ("int", "bool"):
        return f"CAST({v.sql} AS BIGINT)"
    if v.type == "real":
        return f"CAST({v.sql} AS BIGINT)"
    s = as_text(v)
    return f"IF({v.sql} IS NULL, CAST(NULL AS BIGINT), coalesce(try_cast(nullif(regexp_extract({s}, '^\\\\s*([+-]?\\\\d+)', 1), '') AS BIGINT), 0L))"


def as_real(v: Value) -> str:
    if v.type in ("int", "bool", "real"):
        return f"CAST({plain(v)} AS DOUBLE)"
    s = as_text(v)
    return f"IF({v.sql} IS NULL, CAST(NULL AS DOUBLE), coalesce(try_cast(nullif(regexp_extract({s}, '^\\\\s*([+-]?(\\\\d+\\\\.?\\\\d*|\\\\.\\\\d+)([eE][+-]?\\\\d+)?)', 1), '') AS DOUBLE), 0D))"


def lowered(v: Value) -> str:
    """ASCII letters in lower case; others as they are."""
    if isinstance(v.literal, str):
        return quoted(v.literal.translate(str.maketrans(UPPER, LOWER)))
    return f"translate({as_text(v)}, '{UPPER}', '{LOWER}')"


def known(values: list[Value], *types: str) -> bool:
    return all(v.type in types for v in values)


def wider(values: list[Value]) -> str | None:
    kinds = {("int" if v.type == "bool" else v.type) for v in values} - {"null"}
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return kinds.pop()
    return "real" if kinds == {"int", "real"} else None
