"""JSON functions. JSON is text; paths reach into it with Spark's own readers, and only changing it needs Python."""

from __future__ import annotations

import json
import re

from .core import Value, as_text, plain, quoted

_text, _int = (lambda s: Value(s, "text")), (lambda s: Value(s, "int"))
#: Functions whose result is JSON and goes into other JSON as it is.
MAKES_JSON = {"json", "json_array", "json_object", "json_set", "json_insert", "json_replace", "json_remove", "json_patch", "json_group_array", "json_group_object"}


def element(v: Value) -> str:
    """A value as JSON text."""
    if v.type == "json":
        return f"coalesce({v.sql}, 'null')"
    if v.type in ("int", "bool", "real"):
        return f"coalesce(CAST({plain(v)} AS STRING), 'null')"
    if v.type == "null":
        return "'null'"
    told = f"to_json(array({as_text(v)}))"
    return f"substring({told}, 2, char_length({told}) - 2)"


def _path(v: Value) -> str:
    """A path of -> and ->>: a bare label or a number is one step."""
    if isinstance(v.literal, int) and not isinstance(v.literal, bool):
        return quoted(f"$[{v.literal}]")
    if isinstance(v.literal, str) and not v.literal.startswith("$"):
        return quoted(f"$.{v.literal}" if re.fullmatch(r"\w+", v.literal) else f"$['{v.literal}']")
    return as_text(v)


def extract(a: list[Value]) -> Value:
    if len(a) == 2:
        return _text(f"get_json_object({as_text(a[0])}, {_path(a[1])})")
    return Value("concat('[', concat_ws(',', " + ", ".join(_whole(a[0], p) for p in a[1:]) + "), ']')", "json")


def _whole(j: Value, p: Value) -> str:
    return f"coalesce(to_json(variant_get(try_parse_json({as_text(j)}), {_path(p)})), 'null')"


def arrow(j: Value, p: Value, text: bool) -> Value:
    if text:
        return _text(f"get_json_object({as_text(j)}, {_path(p)})")
    return Value(f"to_json(variant_get(try_parse_json({as_text(j)}), {_path(p)}))", "json")


def array(a: list[Value]) -> Value:
    inner = f"concat_ws(',', {', '.join(map(element, a))})" if a else "''"
    return Value(f"concat('[', {inner}, ']')", "json")


def object_(a: list[Value]) -> Value:
    pairs = [f"concat({element(k)}, ':', {element(v)})" for k, v in zip(a[::2], a[1::2], strict=True)]
    inner = f"concat_ws(',', {', '.join(pairs)})" if pairs else "''"
    return Value("concat('{', " + inner + ", '}')", "json")


def type_(a: list[Value]) -> Value:
    v = f"try_parse_json({as_text(a[0])})"
    if len(a) > 1:
        v = f"variant_get({v}, {_path(a[1])})"
    s = f"schema_of_variant({v})"
    return _text(f"CASE WHEN {s} LIKE 'OBJECT%' THEN 'object' WHEN {s} LIKE 'ARRAY%' THEN 'array' WHEN {s} = 'STRING' THEN 'text' WHEN {s} = 'BIGINT' THEN 'integer' WHEN {s} = 'VOID' THEN 'null' WHEN {s} = 'BOOLEAN' THEN lower(CAST({v} AS STRING)) WHEN {s} IS NOT NULL THEN 'real' END")


def array_length(a: list[Value]) -> Value:
    inner = as_text(a[0]) if len(a) == 1 else f"get_json_object({as_text(a[0])}, {_path(a[1])})"
    return _int(f"IF({inner} IS NULL, NULL, coalesce(json_array_length({inner}), 0))")


def edit(mode: str):
    def made(a: list[Value]) -> Value:
        if mode in ("remove", "patch"):
            rest = f"array({', '.join(as_text(p) for p in a[1:])})"
            return Value(f"td_json_edit('{mode}', {as_text(a[0])}, {rest}, array(''))", "json")
        paths, values = a[1::2], a[2::2]
        return Value(f"td_json_edit('{mode}', {as_text(a[0])}, array({', '.join(map(as_text, paths))}), array({', '.join(map(element, values))}))", "json")

    return made


FUNCTIONS = {
    "json": lambda a: Value(f"to_json(parse_json({as_text(a[0])}))", "json"),
    "json_valid": lambda a: _int(f"IF({as_text(a[0])} IS NULL, NULL, IF(try_parse_json({as_text(a[0])}) IS NOT NULL, 1, 0))"),
    "json_extract": extract,
    "json_quote": lambda a: Value(element(a[0]), "json"),
    "json_array": array,
    "json_object": object_,
    "json_type": type_,
    "json_array_length": array_length,
    "json_set": edit("set"),
    "json_insert": edit("insert"),
    "json_replace": edit("replace"),
    "json_remove": edit("remove"),
    "json_patch": edit("patch"),
}

_STEP = re.compile(r"\.(?:\"([^\"]*)\"|([^.\[]+))|\[(#(?:-(\d+))?|\d+)\]")


def _steps(path: str) -> list[str | int | tuple]:
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path: {path!r}")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if m is None:
            raise ValueError(f"bad JSON path: {path!r}")
        out.append(m[1] if m[1] is not None else m[2] if m[2] is not None else ("end", int(m[4] or 0)) if m[3][0] == "#" else int(m[3]))
        at = m.end()
    return out


def _patched(target, patch):
    if not isinstance(patch, dict):
        return patch
    made = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            made.pop(k, None)
        else:
            made[k] = _patched(made.get(k), v)
    return made


def edited(mode: str, told: str | None, paths: list[str], values: list[str]) -> str | None:
    """JSON text after changes; null if the text or a path is null, an error if the text is no JSON."""
    if told is None or any(p is None for p in paths):
        return None
    root = {"": json.loads(told)}
    if mode == "patch":
        root[""] = _patched(root[""], json.loads(paths[0]))
    else:
        for k, path in enumerate(paths):
            _change(mode, root, ["", *_steps(path)], None if mode == "remove" else json.loads(values[k]))
    return json.dumps(root[""], ensure_ascii=False, separators=(",", ":")) if "" in root else None


def _change(mode: str, root: dict, steps: list, value) -> None:
    at = root
    for i, step in enumerate(steps):
        last = i == len(steps) - 1
        if isinstance(step, tuple):
            step = len(at) - step[1] if isinstance(at, list) else None
        if isinstance(at, dict) and isinstance(step, str):
            there = step in at
        elif isinstance(at, list) and isinstance(step, int):
            there = 0 <= step < len(at)
        else:
            return
        if last:
            if mode == "remove":
                if there:
                    del at[step]
            elif there and mode in ("set", "replace"):
                at[step] = value
            elif not there and mode in ("set", "insert"):
                if isinstance(at, dict):
                    at[step] = value
                elif step == len(at):
                    at.append(value)
        elif there:
            at = at[step]
        elif mode in ("set", "insert") and isinstance(at, dict):
            at[step] = {} if isinstance(steps[i + 1], str) else []
            at = at[step]
        else:
            return


#: The columns of json_tree and their types.
TREE = {"key": "text", "value": "text", "type": "text", "atom": "text", "id": "int", "parent": "int", "fullkey": "text", "path": "text"}
_KINDS = {dict: "object", list: "array", str: "text", int: "integer", float: "real", type(None): "null"}


def tree(told: str | None, path: str | None) -> list[tuple]:
    """Every element of a JSON text from `path` on, parents first: the rows of json_tree."""
    if told is None or path is None:
        return []
    root = json.loads(told)
    steps = _steps(path)
    for step in steps:
        if isinstance(step, tuple):
            step = len(root) - step[1] if isinstance(root, list) else None
        if isinstance(root, dict) and step in root or isinstance(root, list) and isinstance(step, int) and 0 <= step < len(root):
            root = root[step]
        else:
            return []
    out: list[tuple] = []
    # A stack, not recursion: nesting may be deep.
    top = re.match(r"(.*?)(?:\.(?:\"[^\"]*\"|[^.\[]+)|\[[^\]]*\])$", path)
    stack = [(None if not steps or isinstance(steps[-1], tuple) else str(steps[-1]), root, None, path, top[1] if top else path)]
    while stack:
        key, value, parent, full, above = stack.pop()
        kind = "true" if value is True else "false" if value is False else _KINDS[type(value)]
        text = json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, (dict, list)) else value if isinstance(value, str) or value is None else str(int(value)) if isinstance(value, (bool, int)) else json.dumps(value)
        mine = len(out)
        out.append((key, text, kind, None if isinstance(value, (dict, list)) else text, mine, parent, full, above))
        inner = [(k, v, mine, full + (f".{k}" if re.fullmatch(r"[A-Za-z_]\w*", k) else f'."{k}"'), full) for k, v in value.items()] if isinstance(value, dict) else [(str(i), v, mine, f"{full}[{i}]", full) for i, v in enumerate(value)] if isinstance(value, list) else []
        stack += inner[::-1]
    return out


def register(spark) -> None:
    """The two Python functions of the dialect, in Arrow batches."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from tidemark.shipping import ship_package

    ship_package(spark)

    def td_json_edit(mode: pd.Series, told: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([edited(m, t, list(p), list(v)) for m, t, p, v in zip(mode, told, paths, values, strict=True)], dtype=object)

    td_json_edit.__annotations__ = {"mode": pd.Series, "told": pd.Series, "paths": pd.Series, "values": pd.Series, "return": pd.Series}
    spark.udf.register("td_json_edit", pandas_udf(td_json_edit, "string"))

    def td_json_tree(told: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(TREE, row, strict=True)) for row in tree(t, p)] for t, p in zip(told, path, strict=True)], dtype=object)

    td_json_tree.__annotations__ = {"told": pd.Series, "path": pd.Series, "return": pd.Series}
    fields = ", ".join(f"{c}: {'bigint' if k == 'int' else 'string'}" for c, k in TREE.items())
    spark.udf.register("td_json_tree", pandas_udf(td_json_tree, f"array<struct<{fields}>>"))
