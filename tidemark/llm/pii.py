"""Format-preserving pseudonyms for personal data.

Found values are validated where their kind allows it (check digits of payment
cards and bank accounts, real calendar dates, numbers that authorities give out),
written as a number in the mixed radix of their format, and that number is
permuted by a keyed Feistel network over just the numbers of the format. So a
card number becomes another valid card number of the same length and grouping, a
date another date, an address another address with letters for letters and digits
for digits; and the same value becomes the same pseudonym in every document, with
no table of values kept anywhere.

A permutation over a domain that is no power of four is had by walking: the network
runs over the next larger one until it lands inside. Numbers are paired, 0 with 1,
2 with 3 and so on; a pair of which one number would stay exchanges its images, so
pseudonyms stay distinct and no paired value stays as it is.

Defined results: a null text stays null with no findings, an empty one empty; spans
do not overlap, the kind that is listed first wins, and of one kind the first in
the text; what fails its validation is left alone; rows that repeat an id or a
text are treated each by itself and get the same pseudonyms; an empty table gives
no rows; a text of any length is read whole, and values longer than `PIECE` are
permuted piece by piece; other columns pass through and may carry any name.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

FEISTEL_ROUNDS = 8
#: Longer values are permuted piece by piece, each piece under a key of its own, so work grows with their length only.
PIECE = 512
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _network(x: int, half: int, key: bytes, tweak: bytes) -> int:
    """A balanced Feistel network over 2 * half bits."""
    mask, size = (1 << half) - 1, (half + 7) // 8
    left, right = x >> half, x & mask
    for k in range(FEISTEL_ROUNDS):
        told, block = b"", 0
        data = right.to_bytes(size, "big")
        while len(told) < size:
            told += hashlib.blake2b(data, digest_size=min(64, size), key=key, salt=bytes([k, block]), person=tweak).digest()
            block += 1
        left, right = right, left ^ (int.from_bytes(told[:size], "big") & mask)
    return (left << half) | right


def _walked(x: int, size: int, key: bytes, tweak: bytes) -> int:
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    x = _network(x, half, key, tweak)
    while x >= size:
        x = _network(x, half, key, tweak)
    return x


def permuted(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of the numbers below `size`; in domains of two or more, fixed numbers are rare and then swapped with a neighbour's image."""
    if size < 2:
        return x
    y = _walked(x, size, key, tweak)
    # Pairs (2k, 2k + 1) exchange images if either is fixed: still a permutation.
    other = x ^ 1
    if other < size:
        z = _walked(other, size, key, tweak)
        if y == x or z == other:
            return z
    return y


_RADIX = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _kind(c: str) -> str:
    return "d" if "0" <= c <= "9" else "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else ""


def _pieces(value: str, key: bytes) -> Iterator[tuple[str, bytes]]:
    for i in range(0, len(value), PIECE):
        yield value[i : i + PIECE], hashlib.blake2b(i.to_bytes(8, "big"), digest_size=32, key=key).digest()


def same_shape(value: str, key: bytes, tweak: bytes) -> str:
    """Digits for digits, letters for letters, everything else in its place."""
    if len(value) > PIECE:
        return "".join(same_shape(piece, own, tweak) for piece, own in _pieces(value, key))
    kinds = [_kind(c) for c in value]
    x, size = 0, 1
    for c, k in zip(value, kinds, strict=True):
        if k:
            x, size = x * len(_RADIX[k]) + _RADIX[k].index(c), size * len(_RADIX[k])
    x = permuted(x, size, key, tweak)
    out = list(value)
    for i in range(len(value) - 1, -1, -1):
        if kinds[i]:
            x, r = divmod(x, len(_RADIX[kinds[i]]))
            out[i] = _RADIX[kinds[i]][r]
    return "".join(out)


def hexadecimal(value: str, key: bytes, tweak: bytes) -> str:
    """A hexadecimal string as another of the same length and case."""
    if len(value) > PIECE:
        return "".join(hexadecimal(piece, own, tweak) if value != value.upper() else hexadecimal(piece, own, tweak).upper() for piece, own in _pieces(value, key))
    made = f"{permuted(int(value, 16), 16 ** len(value), key, tweak):0{len(value)}x}"
    return made.upper() if value.upper() == value else made


def _digits_back(value: str, digits: str) -> str:
    given = iter(digits)
    return "".join(next(given) if c.isdigit() else c for c in value)


def luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total


def card(value: str, key: bytes) -> str | None:
    """Another number with a right check digit; None if this one has none."""
    digits = "".join(c for c in value if c.isdigit())
    if not 13 <= len(digits) <= 19 or luhn_sum(digits) % 10 or len(set(digits)) < 2:
        return None
    body = same_shape(digits[:-1], key, b"card")
    return _digits_back(value, body + str(-luhn_sum(body + "0") % 10))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def account(value: str, key: bytes) -> str | None:
    """An international bank account number: the country stays, the check digits are made anew."""
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = same_shape(plain[4:], key, b"account" + plain[:2].encode())
    told = iter(plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(told) for c in value)


def social(value: str, key: bytes) -> str | None:
    """Area, group and serial that are given out, as others that are."""
    area, group, serial = int(value[:3]), int(value[4:6]), int(value[7:])
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    areas = area - 1 - (area > 666)
    x = permuted((areas * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, b"social")
    areas, rest = divmod(x, 99 * 9999)
    return f"{areas + 1 + (areas >= 665):03d}{value[3]}{rest // 9999 + 1:02d}{value[6]}{rest % 9999 + 1:04d}"


def address(value: str, key: bytes) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if any(p > 255 for p in parts):
        return None
    x = permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"address")
    return ".".join(map(str, x.to_bytes(4, "big")))


#: Written forms of dates: pattern, and the order of year, month and day in it.
_DATES = (
    (re.compile(r"(\d{4})([-/.])(\d{2})\2(\d{2})$"), (1, 3, 4), "{y:04d}{s}{m:02d}{s}{d:02d}"),
    (re.compile(r"(\d{2})([/.-])(\d{2})\2(\d{4})$"), (4, 3, 1), "{d:02d}{s}{m:02d}{s}{y:04d}"),
    (re.compile(r"(\d{2})([/.-])(\d{2})\2(\d{4})$"), (4, 1, 3), "{m:02d}{s}{d:02d}{s}{y:04d}"),
)


def day(value: str, key: bytes) -> str | None:
    """Another day of 1900 to 2099 in the same written form (day before month if both can be read)."""
    for pattern, order, form in _DATES:
        if (m := pattern.match(value)) is not None:
            try:
                x = datetime.date(*(int(m[k]) for k in order)).toordinal()
            except ValueError:
                continue
            if FIRST_DAY <= x <= LAST_DAY:
                made = datetime.date.fromordinal(FIRST_DAY + permuted(x - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"day"))
                return form.format(y=made.year, m=made.month, d=made.day, s=m[2])
    return None


def phone(value: str, key: bytes) -> str | None:
    """The country code stays; the other digits are permuted in their grouping."""
    head = re.match(r"\+\d{1,3}(?=[ .(-])", value)
    start = head.end() if head else 0
    digits = "".join(c for c in value[start:] if c.isdigit())
    if not 7 <= len(digits) <= 14:
        return None
    return value[:start] + _digits_back(value[start:], same_shape(digits, key, b"phone"))


def mail(value: str, key: bytes) -> str | None:
    """Local part and host are permuted together; the last part of the host stays."""
    body, dot, top = value.rpartition(".")
    return same_shape(body, key, b"mail") + dot + top


def secret(value: str, key: bytes) -> str | None:
    if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", value):
        return hexadecimal(value, key, b"secret")
    return same_shape(value, key, b"secret")


_N, _B = r"(?<![\w.])", r"(?![\w])"
#: In the order in which they win: name, pattern (group 1, if there is one, is the value), pseudonym.
KINDS: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("mail", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])", mail),
    ("secret", r"(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passwd|password|pwd|auth)\b[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?)([A-Za-z0-9_./+-]{6,}=*)", secret),
    ("key", r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_](?:live_|test_|proj-)?[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])", secret),
    ("account", _N + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?" + _B, account),
    ("card", _N + r"(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})" + _B, card),
    ("social", _N + r"\d{3}([- ])\d{2}\1\d{4}" + _B, social),
    ("day", _N + r"(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})" + _B, day),
    ("address", _N + r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)", address),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})" + _B, phone),
)
NAMES = tuple(k for k, _, _ in KINDS)


@functools.lru_cache(maxsize=1)
def _compiled() -> tuple:
    # Digits are those of ASCII only, words those of all scripts.
    return tuple((name, re.compile(pattern.replace(r"\d", "[0-9]")), make, "(" in pattern and name in ("secret", "key")) for name, pattern, make in KINDS)


def pseudonymised(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and where in the given text they stand: start, end, kind."""
    found: list[tuple[int, int, str, str]] = []  # disjoint, in order
    digits, mails = any(c in text for c in "0123456789"), "@" in text
    for name, pattern, make, inner in _compiled():
        if (name == "mail" and not mails) or (name in ("account", "card", "social", "day", "address", "phone") and not digits):
            continue
        for m in pattern.finditer(text):
            start, end = m.span(1) if inner else m.span()
            at = bisect.bisect_left(found, (start,))
            clear = (at == 0 or found[at - 1][1] <= start) and (at == len(found) or found[at][0] >= end)
            if clear and (made := make(text[start:end], key)) is not None:
                found.insert(at, (start, end, name, made))
    out, last = [], 0
    for start, end, _, made in found:
        out += [text[last:start], made]
        last = end
    return "".join([*out, text[last:]]), [(a, b, k) for a, b, k, _ in found]


def _replaced(batches: Iterator[pa.RecordBatch], text_at: int, key: bytes) -> Iterator[pa.RecordBatch]:
    shared.serves("pii")
    for batch in batches:
        column = batch.column(text_at)
        texts, counts, spans = [], [], []
        for text in column.to_pylist():
            made, found = (text, []) if text is None else pseudonymised(text, key)
            texts.append(made)
            counts.append([sum(k == name for _, _, k in found) for name in NAMES])
            spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
        columns = [batch.column(i) if i != text_at else pa.array(texts, pa.string()) for i in range(batch.num_columns)]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, span), *[pa.array([c[k] for c in counts], pa.int32()) for k in range(len(NAMES))]], names=[*batch.schema.names, "_td_spans", *[f"_td_{n}" for n in NAMES]])


def replace(docs: DataFrame, key: str, text_col: str = "text", findings: bool = True) -> DataFrame:
    """The documents with pseudonyms; with `findings` also spans (in the given text) and n_<kind> of each kind.

    A finding whose name the input has already gets underscores behind it.
    """
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*[T.StructField(a, docs.schema[c].dataType) for a, c in zip(names, docs.columns, strict=True)], T.StructField("_td_spans", span), *[T.StructField(f"_td_{n}", T.IntegerType()) for n in NAMES]])
    told, at = hashlib.blake2b(key.encode(), digest_size=32).digest(), docs.columns.index(text_col)
    text = names[at]
    made = shared.through(docs.select(*[shared.named(c).alias(a) for c, a in zip(docs.columns, names, strict=True)]), lambda it: _replaced(shared.bounded(it, text), at, told), schema)
    kept = [F.col(a).alias(c) for a, c in zip(names, docs.columns, strict=True)]

    def free(name: str) -> str:
        return name if name.lower() not in {c.lower() for c in docs.columns} else free(name + "_")

    return made.select(*kept, *([F.col("_td_spans").alias(free("spans")), *[F.col(f"_td_{n}").alias(free(f"n_{n}")) for n in NAMES]] if findings else []))
