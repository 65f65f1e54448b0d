"""Tokens and statements of the embedded dialect, and what kind of statement one is."""

from __future__ import annotations

import dataclasses
import re


class DialectError(ValueError):
    """Text that is no statement of the dialect, or one that this engine does not run."""


@dataclasses.dataclass(frozen=True)
class Token:
    #: word, name (a quoted identifier), text, number, blob, param, op
    kind: str
    value: str
    start: int
    end: int

    def is_(self, *words: str) -> bool:
        return self.kind in ("word", "op") and self.value.upper() in words


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|$))
    |(?P<blob>[xX]'(?:[0-9a-fA-F]{2})*')
    |(?P<text>'(?:[^']|'')*')
    |(?P<name>"(?:[^"]|"")*"|\[[^\]]*\]|`(?:[^`]|``)*`)
    |(?P<number>0[xX][0-9a-fA-F]+|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<word>[^\W\d][\w$]*)
    |(?P<param>\?\d*|[:@$][A-Za-z_]\w*)
    |(?P<op>->>|->|\|\||<<|>>|<=|>=|<>|!=|==|[-+*/%&|~<>=(),.;])""",
    re.VERBOSE | re.DOTALL,
)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise DialectError(f"unrecognized token near {text[at : at + 20]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return out


def unquoted(token: Token) -> str:
    """The identifier or text that a quoted token stands for."""
    q = token.value[0]
    if q == "[":
        return token.value[1:-1]
    return token.value[1:-1].replace(q + q, q) if q in "\"'`" else token.value


def statements(text: str) -> list[str]:
    """The statements of a script; semicolons in quotes, comments and trigger bodies do not end one."""
    out, start, depth, words = [], 0, 0, []
    for t in tokens(text):
        if t.kind == "word":
            words.append(t.value.upper())
            trigger = "TRIGGER" in words[:4] and words[0] == "CREATE"
            if trigger and words[-1] in ("BEGIN", "CASE"):
                depth += 1
            elif trigger and words[-1] == "END":
                depth -= 1
        if t.is_(";") and depth <= 0:
            if words or text[start : t.start].strip():
                out.append(text[start : t.start].strip())
            start, depth, words = t.end, 0, []
    if text[start:].strip() and tokens(text[start:]):
        out.append(text[start:].strip())
    return [s for s in out if tokens(s)]


def complete(text: str) -> bool:
    """Whether a text typed so far ends with a whole statement."""
    try:
        found = tokens(text)
    except DialectError:
        return False
    return bool(found) and found[-1].is_(";") and len(statements(text + " SELECT 1")) > len(statements(text)) - (0 if found[-1].is_(";") else 1)


_KINDS = {
    "SELECT": "query", "VALUES": "query", "WITH": "query", "EXPLAIN": "explain", "PRAGMA": "pragma", "INSERT": "dml", "REPLACE": "dml", "UPDATE": "dml", "DELETE": "dml",
    "CREATE": "ddl", "DROP": "ddl", "ALTER": "ddl", "REINDEX": "ddl", "ANALYZE": "ddl", "BEGIN": "tcl", "COMMIT": "tcl", "END": "tcl", "ROLLBACK": "tcl", "SAVEPOINT": "tcl", "RELEASE": "tcl",
    "VACUUM": "vacuum", "ATTACH": "attach", "DETACH": "attach",
}

#: Settings that a stored database may not change; they may be read.
GUARDED = ("journal_mode", "synchronous", "wal_autocheckpoint")


def kind(statement: str) -> str:
    found = tokens(statement)
    if not found:
        raise DialectError("no statement")
    word = found[0].value.upper()
    if word not in _KINDS:
        raise DialectError(f"near {found[0].value!r}: syntax error")
    if word == "WITH":
        depth = 0
        for t in found:
            depth += t.is_("(") - t.is_(")")
            if depth == 0 and t.is_("INSERT", "REPLACE", "UPDATE", "DELETE"):
                return "dml"
    return _KINDS[word]


def guard(statement: str) -> None:
    """Refuses what a stored database does not allow: attaching, and setting three of the settings."""
    found = tokens(statement)
    if found[0].is_("ATTACH", "DETACH"):
        raise DialectError("not authorized: ATTACH and DETACH")
    if found[0].is_("PRAGMA"):
        names = [t.value.lower() for t in found[1:4] if t.kind == "word"]
        if any(n in GUARDED for n in names) and any(t.is_("=", "(") for t in found):
            raise DialectError(f"not authorized: PRAGMA {names[-1]}")


def read_only(statement: str) -> bool:
    """By the first word alone; a statement that begins with WITH counts as one that may write."""
    return bool(re.match(r"\s*(SELECT|PRAGMA|EXPLAIN)\b", statement, re.IGNORECASE))
