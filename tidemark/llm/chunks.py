"""Tokenizing by distinct chunks.

A text is cut before every ASCII white-space byte that follows a character which
surely is no white space. No pre-token of the tokenizers used here reaches over
such a place, and what a tokenizer makes of a chunk does not depend on its
neighbours, so the ids of a text are the ids of its chunks one after the other.
Chunks repeat, so each worker remembers the first `MOST_CHUNKS` chunks that it
meets, which holds all frequent ones; the others are encoded once for each slice.
Chunks of up to `SHORT` bytes are found in a hash table of plain arrays that holds
their bytes (some 40 bytes a chunk, no Python objects); longer ones, which are
rare, in a dictionary of at most `MOST_LONG_BYTES`.

The character before a cut is an ASCII character from 0x21 to 0x7E, or one of
two bytes that starts with 0xC3 to 0xDF: no white space of Unicode is among them.
"""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Callable

import numpy as np

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from . import shared
from .shingles import mix

MOST_CHUNKS = 700_000
SHORT, MOST_LONG_BYTES = 24, 4 << 20

_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x21:0x7F] = True
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xE0] = True
_TRAIL = np.zeros(256, dtype=bool)
_TRAIL[0x80:0xC0] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: the first byte of each text that has one, and every cut."""
    if not len(data):
        return np.zeros(0, np.int64)
    begins = np.zeros(len(data), dtype=bool)
    space = shared.SPACE_BYTES[data]
    begins[1:] = space[1:] & _PLAIN[data[:-1]]
    if len(data) > 2:
        begins[2:] |= space[2:] & _TRAIL[data[1:-1]] & _LEAD[data[:-2]]
    starts = offsets[:-1]
    begins[starts[starts < offsets[1:]]] = True
    return np.flatnonzero(begins)


#: What is left of eight bytes when only the first 0 to 8 of them count.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


class ChunkTable:
    """Slots of short chunks: open addressing, whole arrays of chunks at a time, chunks compared byte for byte."""

    def __init__(self, most: int):
        self.mask = np.int64((1 << max(4, (2 * most - 1).bit_length())) - 1)
        self.place = np.full(int(self.mask) + 1, -1, np.int32)
        self.words = np.zeros((SHORT // 8, most), np.uint64)
        self.sizes = np.zeros(most, np.uint8)

    @staticmethod
    def keys(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The bytes of each chunk as 64-bit words, zero behind its end."""
        padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
        eight = np.ndarray((len(data) + SHORT - 7,), "<u8", buffer=padded, strides=(1,))
        return [eight[begins + k] & _FIRST[np.clip(sizes - k, 0, 8)] for k in range(0, SHORT, 8)]

    def _home(self, keys: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        h = sizes.astype(np.uint64)
        for word in keys:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word)
        return h.view(np.int64) & self.mask

    def find(self, keys: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """The slot of each chunk, -1 for those that are not there."""
        out, at, left = np.full(len(sizes), -1, np.int64), self._home(keys, sizes), np.arange(len(sizes))
        while len(left):
            slot = self.place[at[left]]
            left, slot = left[slot >= 0], slot[slot >= 0]
            same = self.sizes[slot] == sizes[left]
            for mine, word in zip(self.words, keys, strict=True):
                same &= mine[slot] == word[left]
            out[left[same]] = slot[same]
            left = left[~same]
            at[left] = (at[left] + 1) & self.mask
        return out

    def add(self, keys: list[np.ndarray], sizes: np.ndarray, slots: np.ndarray) -> None:
        """Puts in distinct chunks that are not there yet."""
        for mine, word in zip(self.words, keys, strict=True):
            mine[slots] = word
        self.sizes[slots] = sizes
        at, left = self._home(keys, sizes), np.arange(len(sizes))
        while len(left):
            free = left[self.place[at[left]] < 0]
            self.place[at[free]] = slots[free]
            left = left[self.place[at[left]] != slots[left]]
            at[left] = (at[left] + 1) & self.mask


class Encoder:
    """Ids of whole texts by way of their distinct chunks."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]]):
        self.encode_many = encode_many
        self.short = ChunkTable(MOST_CHUNKS)
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        # Memory is touched as slots are used; chunks that are not remembered take the slots behind those that are.
        self.starts = np.zeros(MOST_CHUNKS + (1 << 16), np.int64)
        self.lengths = np.zeros(MOST_CHUNKS + (1 << 16), np.int32)
        self.known = self.used = 0

    def _learn(self, texts: list[str]) -> None:
        """Puts the ids of new chunks behind those in the pool, in slots from self.known on."""
        got = self.encode_many(texts)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        total, first = int(lengths.sum()), self.known
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used // 2 + total, np.uint32)])
        if first + len(texts) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x[:first], np.zeros(len(texts), x.dtype)]) for x in (self.starts, self.lengths))
        self.pool[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(got), np.uint32, total)
        self.starts[first : first + len(texts)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + len(texts)] = lengths

    def _new(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slots of chunks that the table does not have: long ones that are known, and all others once they are encoded."""
        ends = np.cumsum(sizes)
        flat = data[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        found = shared.bytes_array(flat, np.concatenate([[0], ends])).dictionary_encode()
        distinct = found.dictionary
        which = np.diff(np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1])
        slots = np.full(len(distinct), -1, np.int64)
        if self.long:
            for i in np.flatnonzero(which > SHORT).tolist():
                slots[i] = self.long.get(distinct[i].as_py(), -1)
        new = np.flatnonzero(slots < 0)
        if len(new):
            told = distinct.take(pa.array(new))
            self._learn(told.cast(pa.large_string()).to_pylist())
            slots[new] = self.known + np.arange(len(new))
            self._remember(told, which[new])
        return slots[found.indices.to_numpy(zero_copy_only=False)]

    def _remember(self, told: pa.Array, sizes: np.ndarray) -> None:
        """Keeps the first of the new chunks, while there is room for chunks and for the bytes of long ones."""
        room = min(len(told), MOST_CHUNKS - self.known)
        grown = self.long_bytes + np.cumsum(np.where(sizes > SHORT, sizes, 0))
        room = min(room, int(np.searchsorted(grown, MOST_LONG_BYTES, side="right")))
        if room <= 0:
            return
        slots = self.known + np.arange(room)
        told, sizes = told.slice(0, room), sizes[:room]
        data, offsets = shared.text_bytes(told)
        small = sizes <= SHORT
        self.short.add(self.short.keys(data, offsets[:-1][small], sizes[small]), sizes[small], slots[small])
        for i in np.flatnonzero(~small).tolist():
            self.long[told[i].as_py()] = int(slots[i])
        self.long_bytes = int(grown[room - 1])
        self.used += int(self.lengths[slots].sum())
        self.known += room

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after the other, and where each text's ids begin (n + 1 numbers)."""
        data, offsets = shared.text_bytes(column)
        begins = cuts(data, offsets)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        sizes = np.diff(begins, append=len(data))
        slot = np.full(len(begins), -1, np.int64)
        small = np.flatnonzero(sizes <= SHORT)
        slot[small] = self.short.find(self.short.keys(data, begins[small], sizes[small]), sizes[small])
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            slot[missing] = self._new(data, begins[missing], sizes[missing])
        lengths = self.lengths[slot]
        ends = np.cumsum(lengths, dtype=np.int64)
        ids = self.pool[np.repeat(self.starts[slot] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
        return ids, np.concatenate([[0], ends])[np.searchsorted(begins, offsets)]


@functools.lru_cache(maxsize=2)
def library_encoder(path: str, plain: bool = False) -> Encoder:
    """The tokenizers library behind an Encoder; one for each worker.

    plain: strings of special entries in a text are ordinary text, so no text has their ids.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(place(path))
    made.encode_special_tokens = plain
    made.no_truncation()
    made.no_padding()
    return Encoder(lambda texts: [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)])


shared.forgets.append(library_encoder.cache_clear)


def shipped(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary file along with the application; what workers know it by."""
    if (spark.sparkContext.applicationId, path) not in _SHIPPED:
        spark.sparkContext.addFile(path)
        _SHIPPED.add((spark.sparkContext.applicationId, path))
    return path


_SHIPPED: set[tuple[str, str]] = set()


def place(path: str) -> str:
    """Where a worker finds a vocabulary file: under its own path, else where the application's files are."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def with_end(ids: np.ndarray, begins: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    n = len(begins) - 1
    return np.insert(ids, begins[1:], end_id).astype(np.uint32), begins + np.arange(n + 1)
