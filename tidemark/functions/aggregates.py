"""Aggregate functions, plain and over windows."""

from __future__ import annotations

from .core import Value, as_real, as_text, plain, truth
from .jsons import element

NAMES = {"count", "sum", "total", "avg", "min", "max", "group_concat", "string_agg", "json_group_array", "json_group_object", "median", "percentile"}
WINDOW_NAMES = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value"}


def aggregate(name: str, args: list[Value], star: bool, distinct: bool, order: str | None, condition: Value | None, over: str | None) -> Value:
    """order: translated ORDER BY terms inside the call; over: the translated window, if there is one."""
    d = "DISTINCT " if distinct else ""
    if over is not None and condition is not None:
        # Spark has no FILTER on window aggregates: rows that fail it count as null.
        test = truth(condition)
        args = [Value("1", "int")] if star else args
        star = False
        args = [Value(f"CASE WHEN {test} THEN {plain(args[0])} END", args[0].type), *args[1:]]
        condition = None
    keep = f" FILTER (WHERE {truth(condition)})" if condition is not None else ""
    at = f" OVER {over}" if over is not None else ""
    if name == "count":
        return Value(f"count({'*' if star or not args else d + plain(args[0])}){keep}{at}", "int")
    x = args[0]
    if name == "sum":
        return Value(f"sum({d}{plain(x) if x.type in ('int', 'real', 'bool') else as_real(x)}){keep}{at}", "int" if x.type in ("int", "bool") else "real")
    if name == "total":
        return Value(f"coalesce(sum({d}{as_real(x)}){keep}{at}, 0D)", "real")
    if name == "avg":
        return Value(f"avg({d}{as_real(x)}){keep}{at}", "real")
    if name in ("min", "max"):
        return Value(f"{name}({plain(x)}){keep}{at}", x.type)
    if name in ("median", "percentile"):
        p = "0.5" if name == "median" else f"{as_real(args[1])} / 100"
        return Value(f"percentile({as_real(x)}, {p}){keep}{at}", "real")
    if name in ("group_concat", "string_agg"):
        sep = as_text(args[1]) if len(args) > 1 else "','"
        if at:
            return Value(f"nullif(array_join(collect_list({as_text(x)}){at}, {sep}), '')", "text")
        within = f" WITHIN GROUP (ORDER BY {order})" if order else ""
        return Value(f"listagg({d}{as_text(x)}, {sep}){within}{keep}", "text")
    if name == "json_group_array":
        return Value(f"concat('[', array_join(collect_list({element(x)}){keep}{at}, ','), ']')", "json")
    if name == "json_group_object":
        return Value("concat('{', array_join(collect_list(" + f"concat({element(x)}, ':', {element(args[1])})" + f"){keep}{at}, ','), '}}')", "json")
    raise KeyError(name)


def window(name: str, args: list[Value], over: str) -> Value:
    kinds = {"percent_rank": "real", "cume_dist": "real"}
    told = ", ".join(plain(a) for a in args)
    if name in ("lag", "lead", "first_value", "last_value", "nth_value"):
        return Value(f"{name}({told}) OVER {over}", args[0].type)
    return Value(f"{name}({told}) OVER {over}", kinds.get(name, "int"))


def _remains(start: str, end: str) -> list[tuple[str, str]]:
    """The parts of a frame before and after the current row or peer group."""
    rank = {"UNBOUNDED PRECEDING": -2, "CURRENT ROW": 0, "UNBOUNDED FOLLOWING": 2}
    side = lambda x: rank.get(x, -1 if x.endswith("PRECEDING") else 1)
    out = []
    if side(start) < 0:
        out.append((start, "1 PRECEDING" if side(end) >= 0 else end))
    if side(end) > 0:
        out.append(("1 FOLLOWING" if side(start) <= 0 else start, end))
    return out


def excluding(name: str, args: list[Value], x) -> Value:
    """An aggregate over a window with EXCLUDE (see dialect.Exclusion), from the parts of the frame that stay.

    CURRENT ROW leaves the rows before and after it, GROUP the peer groups before and after that of the row, TIES these
    and the row itself. Frames of ranges keep their rows less the row: what a sum or count can be corrected for.
    """
    rows = f"{x.partition} {x.order} {x.unit} BETWEEN".strip()
    own = plain(args[0]) if args else "1"
    number = as_real(args[0]) if args and name in ("avg", "total") else own
    if x.unit == "ROWS" and x.kind == "ROW" or x.unit == "RANGE" and x.order.startswith("ORDER BY _td_g") and x.kind in ("GROUP", "TIES"):
        parts = [f"({rows} {a} AND {b})" for a, b in _remains(x.start, x.end)]
        stays = x.kind == "TIES"
    elif x.unit == "RANGE" and x.kind == "ROW" and name not in ("min", "max"):
        parts, stays = None, False
    else:
        raise ValueError(f"EXCLUDE with a {x.unit} frame is not supported for {name}")
    if name in ("min", "max"):
        told = [f"{name}({own}) OVER {w}" for w in parts] + [own] * stays
        pick = "least" if name == "min" else "greatest"
        return Value(f"{pick}({', '.join(told)})" if len(told) > 1 else told[0] if told else "NULL", args[0].type)
    if name not in ("sum", "total", "avg", "count"):
        raise ValueError(f"EXCLUDE is not supported for {name}")
    here = f"IF({own} IS NULL, 0, 1)"
    if parts is None:
        n, total = f"(count({own}) OVER {x.whole} - {here})", f"(coalesce(sum({number}) OVER {x.whole}, 0) - coalesce({number}, 0))"
    else:
        n = " + ".join([f"count({own}) OVER {w}" for w in parts] + [here] * stays) or "0"
        total = " + ".join([f"coalesce(sum({number}) OVER {w}, 0)" for w in parts] + [f"coalesce({number}, 0)"] * stays) or "0"
    if name == "count":
        return Value(f"({n})", "int")
    if name == "total":
        return Value(f"CAST({total} AS DOUBLE)", "real")
    if name == "avg":
        return Value(f"try_divide(CAST({total} AS DOUBLE), {n})", "real")
    return Value(f"CASE WHEN ({n}) > 0 THEN {total} END", "int" if args[0].type in ("int", "bool") else "real")
