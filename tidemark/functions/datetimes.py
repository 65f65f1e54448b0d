"""Date and time functions with their modifiers."""

from __future__ import annotations

import re

from .core import Value, as_real, quoted


class ModifierError(ValueError):
    pass


_UNITS = {"second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY"}
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(ts: str) -> str:
    return f"timestampdiff(MICROSECOND, {_EPOCH}, {ts})"


def _from_seconds(seconds: str) -> str:
    return f"timestampadd(MICROSECOND, CAST(round(({seconds}) * 1000000D) AS BIGINT), {_EPOCH})"


def _from_julian(day: str) -> str:
    return _from_seconds(f"(({day}) - 2440587.5D) * 86400D")


def _day(ts: str) -> str:
    return f"CAST({ts} AS DATE)"


def _with_time(day: str, ts: str) -> str:
    """A day with the time of another timestamp."""
    return f"timestampadd(MICROSECOND, timestampdiff(MICROSECOND, CAST({_day(ts)} AS TIMESTAMP_NTZ), {ts}), CAST({day} AS TIMESTAMP_NTZ))"


def _shifted_months(ts: str, n: int) -> str:
    """Months are added to the month alone; days beyond its end run over into the next."""
    return _with_time(f"date_add(add_months(trunc({_day(ts)}, 'MM'), {n}), day({ts}) - 1)", ts)


def timestamp(args: list[Value]) -> str:
    """A TIMESTAMP_NTZ expression of a time value and its modifiers."""
    value = args[0] if args else Value("'now'", "text", "now")
    mods = []
    for a in args[1:]:
        if not isinstance(a.literal, str):
            raise ModifierError("time modifiers must be text literals")
        mods.append(a.literal.strip().lower())
    if value.type == "ts":
        ts = value.sql
    elif value.literal == "now":
        ts = "CAST(convert_timezone('UTC', CAST(current_timestamp() AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ)"
    elif value.type in ("int", "real"):
        if mods and mods[0] in ("unixepoch", "auto"):
            ts = _from_seconds(as_real(value))
            mods = mods[1:]
        else:
            ts = _from_julian(as_real(value))
    elif isinstance(value.literal, str) and re.fullmatch(r"\d\d:\d\d(:\d\d(\.\d+)?)?", value.literal):
        ts = f"try_cast({quoted('2000-01-01 ' + value.literal)} AS TIMESTAMP_NTZ)"
    else:
        ts = f"try_cast({value.sql} AS TIMESTAMP_NTZ)"
    for m in mods:
        if m in ("utc", "localtime", "subsec", "subsecond", "auto"):
            continue
        if m == "start of day":
            ts = f"CAST({_day(ts)} AS TIMESTAMP_NTZ)"
        elif m in ("start of month", "start of year"):
            ts = f"CAST(trunc({_day(ts)}, '{'MM' if m.endswith('month') else 'YEAR'}') AS TIMESTAMP_NTZ)"
        elif found := re.fullmatch(r"weekday ([0-6])", m):
            ts = _with_time(f"date_add({_day(ts)}, pmod({found[1]} - (dayofweek({ts}) - 1), 7))", ts)
        elif found := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) (second|minute|hour|day|month|year)s?", m):
            n, unit = found[1], found[2]
            if unit in ("month", "year"):
                ts = _shifted_months(ts, int(float(n)) * (12 if unit == "year" else 1))
            elif float(n).is_integer():
                ts = f"timestampadd({_UNITS[unit]}, {int(float(n))}, {ts})"
            else:
                seconds = float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
                ts = f"timestampadd(MICROSECOND, {round(seconds * 1e6)}, {ts})"
        else:
            raise ModifierError(f"unknown time modifier {m!r}")
    return ts


def _format(ts: str, pattern: str) -> str:
    return f"date_format({ts}, '{pattern}')"


#: What each letter of a format stands for.
_PIECES = {
    "Y": lambda t: _format(t, "yyyy"), "m": lambda t: _format(t, "MM"), "d": lambda t: _format(t, "dd"), "H": lambda t: _format(t, "HH"), "M": lambda t: _format(t, "mm"), "S": lambda t: _format(t, "ss"),
    "j": lambda t: _format(t, "DDD"), "w": lambda t: f"CAST(dayofweek({t}) - 1 AS STRING)", "u": lambda t: f"CAST(pmod(dayofweek({t}) + 5, 7) + 1 AS STRING)",
    "W": lambda t: f"lpad(CAST((dayofyear({t}) + 6 - pmod(dayofweek({t}) + 5, 7)) DIV 7 AS STRING), 2, '0')",
    "s": lambda t: f"CAST({micros(t)} DIV 1000000 AS STRING)", "f": lambda t: _format(t, "ss.SSS"), "J": lambda t: f"CAST({julianday(t)} AS STRING)",
    "F": lambda t: _format(t, "yyyy-MM-dd"), "T": lambda t: _format(t, "HH:mm:ss"), "R": lambda t: _format(t, "HH:mm"), "e": lambda t: f"lpad(CAST(day({t}) AS STRING), 2, ' ')", "I": lambda t: _format(t, "hh"), "p": lambda t: f"IF(hour({t}) < 12, 'AM', 'PM')",
}


def julianday(ts: str) -> str:
    return f"({micros(ts)} / 86400000000D + 2440587.5D)"


def strftime(args: list[Value]) -> Value:
    if not args or not isinstance(args[0].literal, str):
        raise ModifierError("strftime needs a text literal as its format")
    ts, parts, at, told = timestamp(args[1:]), [], 0, args[0].literal
    for m in re.finditer(r"%(.)", told):
        if m.start() > at:
            parts.append(quoted(told[at : m.start()]))
        if m[1] != "%" and m[1] not in _PIECES:
            return Value("CAST(NULL AS STRING)", "text")
        parts.append("'%'" if m[1] == "%" else _PIECES[m[1]](ts))
        at = m.end()
    if told[at:]:
        parts.append(quoted(told[at:]))
    return Value(f"concat({', '.join(parts)})" if parts else "''", "text")


def timediff(args: list[Value]) -> Value:
    a, b = timestamp(args[:1]), timestamp(args[1:2])
    lo, hi = f"least({a}, {b})", f"greatest({a}, {b})"
    months = f"timestampdiff(MONTH, {lo}, {hi})"
    rest = f"timestampdiff(MICROSECOND, timestampadd(MONTH, {months}, {lo}), {hi})"
    number = lambda x, n: f"lpad(CAST({x} AS STRING), {n}, '0')"
    text = [f"IF({a} < {b}, '-', '+')", number(f"{months} DIV 12", 4), "'-'", number(f"{months} % 12", 2), "'-'", number(f"{rest} DIV 86400000000", 2), "' '", number(f"{rest} DIV 3600000000 % 24", 2), "':'", number(f"{rest} DIV 60000000 % 60", 2), "':'", number(f"{rest} DIV 1000000 % 60", 2), "'.'", number(f"{rest} DIV 1000 % 1000", 3)]
    return Value(f"concat({', '.join(text)})", "text")


FUNCTIONS = {
    "date": lambda a: Value(_format(timestamp(a), "yyyy-MM-dd"), "text"),
    "time": lambda a: Value(_format(timestamp(a), "HH:mm:ss"), "text"),
    "datetime": lambda a: Value(_format(timestamp(a), "yyyy-MM-dd HH:mm:ss"), "text"),
    "julianday": lambda a: Value(julianday(timestamp(a)), "real"),
    "unixepoch": lambda a: Value(f"({micros(timestamp(a))} DIV 1000000)", "int"),
    "strftime": strftime,
    "timediff": timediff,
    "current_date": lambda a: Value(_format(timestamp([]), "yyyy-MM-dd"), "text"),
    "current_time": lambda a: Value(_format(timestamp([]), "HH:mm:ss"), "text"),
    "current_timestamp": lambda a: Value(_format(timestamp([]), "yyyy-MM-dd HH:mm:ss"), "text"),
}
