"""Byte-level BPE by backtracking over longest matches.

Encoding. One pass of an Aho-Corasick automaton over a pre-token finds the
longest vocabulary entry that begins at each byte. The encoder takes the longest
entry, falls back to its longest proper prefix that is an entry, or steps back
over the entry before, until neighbours are compatible. Two neighbours are
compatible when BPE leaves them apart if it is given just their bytes; a
sequence whose neighbours are all compatible is the one that BPE makes of the
whole. A bit for each place stops the search from meeting a dead end twice, so
the work is linear in the length.

Compatibility is read off the merges: the right edge of the left entry and the
left edge of the right entry are each a chain of parts, a part existing from the
rank of the merge that makes it to the rank of the merge that takes it up. The
pair is incompatible if some merge joins two parts that exist at its rank. The
answers are kept in a table.

Decoding. Bytes of all entries lie one after the other in one array; an offset
table gives each id's part of it, so decoding is a gather.

Defined results: a null or empty text has no ids and decodes to the empty text;
strings of special entries in a text become their ids, as the library does. Rows
with a null id, and rows that repeat an id, are each encoded by their own text; an
empty table gives no rows; other columns are not read. A very long text is a slice
of its own, at some 30 bytes of arrays a byte.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, shared

#: The pre-token pattern of this family of vocabularies (a fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 stands for itself, the rest is numbered from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {chr(b if b in printable else next(others)): b for b in range(256)}


class Vocabulary:
    """Entries, merges, automaton and tables of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(chunks.place(path), encoding="utf-8") as f:
            told = json.load(f)
        letters, model = byte_letters(), told["model"]
        spelled = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.entry: list[bytes] = [b""] * size
        for t, i in model["vocab"].items():
            self.entry[i] = spelled.get(t, t.encode())
        for t, i in self.special.items():
            self.entry[i] = t.encode()
        #: Of each entry the rank of the merge that makes it (-1: a single byte) and the two parts.
        self.made = [NEVER] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merge: dict[tuple[int, int], int] = {}
        for t, i in model["vocab"].items():
            if len(spelled.get(t, b"")) == 1:
                self.made[i] = -1
        for rank, pair in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = model["vocab"][f"{self._text(model, a)}{self._text(model, b)}"]
            self.merge.setdefault((a, b), rank)
            if self.made[whole] == NEVER:
                self.made[whole], self.parts[whole] = rank, (a, b)
        self.automaton, usable = ahocorasick.Automaton(), {}
        for i, b in enumerate(self.entry):
            if self.made[i] != NEVER:
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
                usable[b] = i
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for b, i in usable.items():
            for n in range(len(b) - 1, 0, -1):
                if (j := usable.get(b[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.compatible: dict[tuple[int, int], bool] = {}
        ends = np.cumsum([len(b) for b in self.entry])
        self.offsets = np.concatenate([[0], ends]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(self.entry), np.uint8)
        self.pattern = regex.compile(PRE_TOKEN)
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    @functools.cached_property
    def names(self) -> dict[int, str]:
        return {}

    def _text(self, model: dict, i: int) -> str:
        if not self.names:
            self.names.update({v: k for k, v in model["vocab"].items()})
        return self.names[i]

    def _edge(self, i: int, side: int) -> list[tuple[int, int]]:
        """The parts on one edge of an entry, each with the rank of the merge that takes it up."""
        found, until = [(i, NEVER)], NEVER
        while (parts := self.parts[i]) is not None:
            until, i = self.made[i], parts[side]
            found.append((i, until))
        return found

    def stays_apart(self, left: int, right: int) -> bool:
        if (known := self.compatible.get((left, right))) is not None:
            return known
        answer = True
        edge = self._edge(right, 0)
        for a, a_until in self._edge(left, 1):
            for b, b_until in edge:
                rank = self.merge.get((a, b))
                # Equal merges run from the left: a part taken up by the same merge on its left is gone, one on its right is not yet.
                if rank is not None and max(self.made[a], self.made[b]) < rank < a_until and rank <= b_until:
                    answer = False
        if len(self.compatible) < 1_000_000:
            self.compatible[(left, right)] = answer
        return answer

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(piece)
        longest, reach = [-1] * n, [0] * n
        for end, (size, i) in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - size
            if size > reach[start]:
                longest[start], reach[start] = i, size
        open_places = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, trial = 0, longest[0] if n else -1
        while at < n:
            while trial >= 0 and not (open_places[at + len(self.entry[trial])] and (not out or self.stays_apart(out[-1], trial))):
                trial = self.shorter[trial]
            if trial >= 0:
                out.append(trial)
                at += len(self.entry[trial])
                trial = longest[at] if at < n else -1
            else:
                open_places[at] = 0
                trial = out.pop()
                at -= len(self.entry[trial])
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.marks.split(text) if self.marks else [text]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for piece in self.pattern.findall(part):
                    ids += self.encode_piece(piece.encode())
        return ids

    def decode_many(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each text begins."""
        sizes = self.offsets[ids + np.int64(1)] - self.offsets[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self.flat[np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(total)]
        return data, np.concatenate([[0], ends])[begins]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> chunks.Encoder:
    made = vocabulary(path)
    return chunks.Encoder(lambda texts: [made.encode(t) for t in texts])


shared.forgets += [encoder.cache_clear, vocabulary.cache_clear]


def decimal_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every id as ',digits': bytes and offsets."""
    told = [f",{i}".encode() for i in range(size)]
    return np.frombuffer(b"".join(told), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in told])]).astype(np.int64)


def _gather(flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = offsets[ids + np.int64(1)] - offsets[ids]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets[ids] - (ends - sizes), sizes) + np.arange(total)], np.concatenate([[0], ends])


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, outputs: bool) -> Iterator[pa.RecordBatch]:
    shared.serves("bpe")
    made, own = vocabulary(path), encoder(path)
    digits, digit_offsets = decimal_table(len(made.entry))
    for batch in shared.bounded(batches, "text", 2 << 20):
        ids, begins = own.encode(batch.column("text"))
        data, places = made.decode_many(ids, begins)
        told, told_at = _gather(digits, digit_offsets, ids)
        told_at = told_at[begins]
        n = batch.num_rows
        columns = [batch.column("doc_id"), pa.array(np.diff(begins))]
        texts = [data[places[i] : places[i + 1]].tobytes().decode("utf-8", "replace") for i in range(n)]
        columns.append(pa.array([hashlib.sha256(told[told_at[i] + 1 : told_at[i + 1]]).hexdigest() for i in range(n)]))
        columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if outputs:
            columns += [pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(ids.astype(np.int64))), pa.array(texts)]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = False) -> DataFrame:
    """Ids and decoded text of every document, as digests; with `outputs` also as `ids` and `decoded`."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * outputs
    path = chunks.shipped(docs.sparkSession, path)
    rows = docs.select(shared.named(id_col).cast("long").alias("doc_id"), F.coalesce(shared.named(text_col), F.lit("")).alias("text"))
    return shared.through(rows, lambda it: _round_trip(it, path, outputs), schema)
