"""String, mathematical and general scalar functions."""

from __future__ import annotations

import re

from .core import LOWER, UPPER, Value, as_int, as_real, as_text, known, plain, quoted, truth, wider

_text, _int, _real = (lambda s: Value(s, "text")), (lambda s: Value(s, "int")), (lambda s: Value(s, "real"))


def substr(a: list[Value]) -> Value:
    """Places count from 1, negative ones from the end; place 0 lies before the first, and a negative length takes what stands before."""
    s, start = as_text(a[0]), plain(a[1])
    n = f"char_length({s})"
    # The first place as a number from 1, which may lie before the text.
    first = f"CASE WHEN {start} > 0 THEN {start} WHEN {start} = 0 THEN 0 ELSE {n} + {start} + 1 END"
    if isinstance(a[1].literal, int) and a[1].literal > 0 and (len(a) == 2 or isinstance(a[2].literal, int) and a[2].literal >= 0):
        return _text(f"substring({s}, {start}{f', {a[2].literal}' if len(a) > 2 else ''})")
    if len(a) == 2:
        return _text(f"substring({s}, greatest({first}, 1))")
    size = plain(a[2])
    low = f"IF({size} < 0, {first} + {size}, {first})"
    high = f"IF({size} < 0, {first}, {first} + {size})"
    return _text(f"substring({s}, greatest({low}, 1), greatest(0, {high} - greatest({low}, 1)))")


def printf(a: list[Value]) -> Value:
    """Arguments are cast to what their place in a literal format asks for."""
    if not isinstance(a[0].literal, str):
        return _text(f"format_string({', '.join(as_text(x) for x in a)})")
    args, out, k = [], [], 1
    for m in re.finditer(r"%(?P<flags>[-+ 0#,]*)(?P<width>\d*)(?P<precision>\.\d+)?(?:ll|l)?(?P<kind>[a-zA-Z%])|[^%]+|%", a[0].literal):
        kind = m["kind"]
        if not kind or kind == "%":
            out.append("%%" if kind == "%" else m[0])
            continue
        x = a[k] if k < len(a) else Value("NULL", "null")
        k += 1
        head = f"%{m['flags']}{m['width']}"
        if kind in "di":
            out.append(head + "d")
            args.append(f"coalesce({as_int(x)}, 0L)")
        elif kind in "fFeEgG":
            out.append(head + (m["precision"] or "") + kind.replace("F", "f"))
            args.append(f"coalesce({as_real(x)}, 0D)")
        elif kind in "xXo":
            out.append(head + kind)
            args.append(f"coalesce({as_int(x)}, 0L)")
        elif kind in "szcqQw":
            s = as_text(x)
            s = {"c": f"left({s}, 1)", "q": f"replace({s}, '\\'', '\\'\\'')", "w": f"replace({s}, '\"', '\"\"')", "Q": quote([x]).sql}.get(kind, s)
            out.append(head + (m["precision"] or "") + "s")
            args.append(f"coalesce({s}, {quoted('NULL' if kind == 'Q' else '')})")
        else:
            raise ValueError(f"unknown conversion %{kind}")
    return _text(f"format_string({', '.join([quoted(''.join(out)), *args])})")


def quote(a: list[Value]) -> Value:
    x = a[0]
    if x.type in ("int", "real", "bool"):
        told = as_text(x)
    elif x.type == "blob":
        told = f"concat('X\\'', hex({x.sql}), '\\'')"
    else:
        told = f"concat('\\'', replace({as_text(x)}, '\\'', '\\'\\''), '\\'')"
    return _text(f"coalesce({told}, 'NULL')")


def typeof(a: list[Value]) -> Value:
    names = {"int": "integer", "bool": "integer", "real": "real", "text": "text", "ts": "text", "blob": "blob"}
    x = a[0]
    if x.type == "null":
        return _text("'null'")
    if x.type in names:
        return _text(f"IF({x.sql} IS NULL, 'null', '{names[x.type]}')")
    return _text(f"CASE WHEN {x.sql} IS NULL THEN 'null' WHEN typeof({x.sql}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN typeof({x.sql}) IN ('float', 'double') OR typeof({x.sql}) LIKE 'decimal%' THEN 'real' WHEN typeof({x.sql}) = 'binary' THEN 'blob' ELSE 'text' END")


def extreme(name: str):
    def made(a: list[Value]) -> Value:
        args = [plain(x) for x in a if x.type != "null"]
        if len(args) < len(a):
            return Value("NULL", "null")
        null = " OR ".join(f"{x} IS NULL" for x in args)
        return Value(f"IF({null}, NULL, {name}({', '.join(args)}))", wider(a))

    return made


def _number(template: str):
    """A function of doubles that is null outside its domain."""
    return lambda a: _real(f"nullif({template.format(*[as_real(x) for x in a])}, double('NaN'))")


def log(a: list[Value]) -> Value:
    """With one argument to base 10, with two the first is the base."""
    x = as_real(a[-1])
    return _real(f"log10({x})" if len(a) == 1 else f"(ln({x}) / nullif(ln({as_real(a[0])}), 0D))")


def rounded(a: list[Value]) -> Value:
    digits = max(a[1].literal, 0) if len(a) > 1 and isinstance(a[1].literal, int) else f"greatest({as_int(a[1])}, 0)" if len(a) > 1 else 0
    return _real(f"CAST(round({as_real(a[0])}, {digits}) AS DOUBLE)")


def whole(name: str):
    def made(a: list[Value]) -> Value:
        if a[0].type in ("int", "bool"):
            return _int(plain(a[0]))
        x = as_real(a[0])
        call = f"CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END" if name == "trunc" else f"{name}({x})"
        return _real(f"CAST({call} AS DOUBLE)")

    return made


def mod(a: list[Value]) -> Value:
    if known(a, "int", "bool"):
        return _int(f"try_mod({plain(a[0])}, {plain(a[1])})")
    return _real(f"try_mod({as_real(a[0])}, {as_real(a[1])})")


def trim(name: str):
    def made(a: list[Value]) -> Value:
        s, chars = as_text(a[0]), as_text(a[1]) if len(a) > 1 else "' '"
        return _text({"trim": f"btrim({s}, {chars})", "ltrim": f"ltrim({chars}, {s})", "rtrim": f"rtrim({chars}, {s})"}[name])

    return made


def likeness(a: list[Value]) -> Value:
    return Value(f"({lowered_sql(a[1])} LIKE {lowered_sql(a[0])})", "bool")


def lowered_sql(v: Value) -> str:
    from .core import lowered

    return lowered(v)


def soundex(a: list[Value]) -> Value:
    return _text(f"coalesce(nullif(soundex({as_text(a[0])}), ''), '?000')")


def case(of: str, to: str):
    return lambda a: _text(f"translate({as_text(a[0])}, '{of}', '{to}')")


FUNCTIONS = {
    "length": lambda a: _int(f"octet_length({a[0].sql})" if a[0].type == "blob" else f"char_length({as_text(a[0])})"),
    "octet_length": lambda a: _int(f"octet_length({as_text(a[0])})"),
    "substr": substr,
    "substring": substr,
    "upper": case(LOWER, UPPER),
    "lower": case(UPPER, LOWER),
    "trim": trim("trim"),
    "ltrim": trim("ltrim"),
    "rtrim": trim("rtrim"),
    "replace": lambda a: _text(f"replace({', '.join(map(as_text, a))})"),
    "instr": lambda a: _int(f"instr({as_text(a[0])}, {as_text(a[1])})"),
    "printf": printf,
    "format": printf,
    "hex": lambda a: _text(f"hex(CAST({a[0].sql if a[0].type == 'blob' else as_text(a[0])} AS BINARY))"),
    "unhex": lambda a: Value(f"unhex({as_text(a[0])})", "blob"),
    "char": lambda a: _text("concat(" + ", ".join(f"decode(unhex(lpad(hex({as_int(x)}), 8, '0')), 'UTF-32')" for x in a) + ")"),
    "unicode": lambda a: _int(f"nullif(ascii({as_text(a[0])}), 0)"),
    "zeroblob": lambda a: Value(f"unhex(repeat('00', CAST({as_int(a[0])} AS INT)))", "blob"),
    "randomblob": lambda a: Value(f"unhex(left(repeat(replace(uuid(), '-', ''), CAST({as_int(a[0])} DIV 16 + 1 AS INT)), CAST({as_int(a[0])} * 2 AS INT)))", "blob"),
    "random": lambda a: _int("xxhash64(uuid())"),
    "quote": quote,
    "typeof": typeof,
    "soundex": soundex,
    "concat": lambda a: _text("concat(" + ", ".join(f"coalesce({as_text(x)}, '')" for x in a) + ")"),
    "concat_ws": lambda a: _text(f"concat_ws({', '.join(map(as_text, a))})"),
    "like": likeness,
    "glob": lambda a: Value(f"({as_text(a[1])} RLIKE {glob_pattern(a[0])})", "bool"),
    "max": extreme("greatest"),
    "min": extreme("least"),
    "abs": lambda a: Value(f"abs({plain(a[0])})", a[0].type),
    "sign": lambda a: _int(f"CAST(sign({plain(a[0])}) AS INT)"),
    "coalesce": lambda a: Value(f"coalesce({', '.join(map(plain, a))})", wider(a)),
    "ifnull": lambda a: Value(f"coalesce({', '.join(map(plain, a))})", wider(a)),
    "nullif": lambda a: Value(f"nullif({plain(a[0])}, {plain(a[1])})", a[0].type),
    "iif": lambda a: Value(f"IF({truth(a[0])}, {plain(a[1])}, {plain(a[2]) if len(a) > 2 else 'NULL'})", wider(a[1:])),
    "if": lambda a: Value(f"IF({truth(a[0])}, {plain(a[1])}, {plain(a[2]) if len(a) > 2 else 'NULL'})", wider(a[1:])),
    "likely": lambda a: a[0],
    "unlikely": lambda a: a[0],
    "sqlite_version": lambda a: _text("'3.53.4'"),
    "log": log,
    "log10": lambda a: _real(f"log10({as_real(a[0])})"),
    "log2": lambda a: _real(f"log2({as_real(a[0])})"),
    "ln": lambda a: _real(f"ln({as_real(a[0])})"),
    "exp": _number("exp({0})"),
    "sqrt": _number("sqrt({0})"),
    "pow": _number("power({0}, {1})"),
    "power": _number("power({0}, {1})"),
    "pi": lambda a: _real("pi()"),
    "atan2": _number("atan2({0}, {1})"),
    "round": rounded,
    "ceil": whole("ceil"),
    "ceiling": whole("ceil"),
    "floor": whole("floor"),
    "trunc": whole("trunc"),
    "mod": mod,
} | {name: _number(name + "({0})") for name in ("acos", "acosh", "asin", "asinh", "atan", "atanh", "cos", "cosh", "degrees", "radians", "sin", "sinh", "tan", "tanh")}


def glob_pattern(v: Value) -> str:
    """A GLOB pattern as an anchored regular expression; it must be a literal."""
    if not isinstance(v.literal, str):
        raise ValueError("GLOB needs a text literal as its pattern")
    out, i, told = [], 0, v.literal
    while i < len(told):
        c = told[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := told.find("]", i + 2 + (told[i + 1 : i + 2] == "^"))) > 0:
            body = told[i + 1 : end]
            inverse = body.startswith("^")
            out.append("[" + "^" * inverse + re.sub(r"([\\\[\]&^])", r"\\\1", body[inverse:]) + "]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return quoted("(?s)^" + "".join(out) + "$")
