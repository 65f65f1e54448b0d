"""Sets of word shingles as sorted arrays of 64-bit hashes, and their sketches.

The sketch is fast similarity sketching: t bins, filled in rounds. In round i of
the first t, every shingle goes to a bin drawn by a hash of its own for that
round; in round t + j all shingles go to bin j. A bin keeps the smallest hash of
the first round that reaches it, and the rounds end when no bin is empty. A set
of t ln t shingles or more is done after about one round, and after 2 t rounds
every bin of any set that is not empty is full. Each bin of two sets agrees with
a probability of their Jaccard similarity, and the number of agreeing bins is
concentrated as for independent draws.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash

from . import shared

_U = np.uint64
_K1, _K2, _K3 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _K1
    x = (x ^ (x >> _U(27))) * _K2
    return x ^ (x >> _U(31))


def sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text, sorted, one text after the other, and where each text's begin (n + 1 numbers).

    A text with fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    data, offsets = shared.text_bytes(column)
    n = len(offsets) - 1
    inside = ~shared.SPACE_BYTES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    before = np.concatenate([[0], np.cumsum(inside)])
    words = shared.bytes_array(_LOWER[data[inside]], np.append(before[at], before[-1])).dictionary_encode()
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    h = hashed[words.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.uint64)
    first = np.searchsorted(at, offsets)
    counts = np.diff(first)
    out = []
    if len(h) >= width:
        whole = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            whole = mix(whole * _K3 + h[k : k + len(whole)] + _U(k + 1))
    for i in range(n):
        if counts[i] >= width:
            own = np.sort(whole[first[i] : first[i + 1] - width + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif counts[i]:
            short = np.zeros(1, np.uint64)
            for k, w in enumerate(h[first[i] : first[i + 1]]):
                short = mix(short * _K3 + w + _U(k + 1))
            own = mix(short + _U(int(counts[i])))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
    sizes = np.fromiter(map(len, out), np.int64, n)
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])


def sketches(members: np.ndarray, begins: np.ndarray, bins: int = 128) -> np.ndarray:
    """One row of `bins` 16-bit values for each set; rows of empty sets are zero."""
    n = len(begins) - 1
    top = _U(0xFFFFFFFFFFFFFFFF)
    kept = np.full(n * bins, top, np.uint64)
    sizes = np.diff(begins)
    doc = np.repeat(np.arange(n), sizes)
    active = members
    for i in range(2 * bins):
        if not len(active):
            break
        h = mix(active + _U((i + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        bin_of = (h >> _U(40)).astype(np.int64) % bins if i < bins else np.full(len(h), i - bins)
        value = mix(h) >> _U(1)
        place = doc * bins + bin_of
        free = kept[place] == top
        fresh = np.full(n * bins, top, np.uint64) if free.all() and n * bins < 4 * len(h) else None
        if fresh is not None:
            np.minimum.at(fresh, place, value)
            kept = np.minimum(kept, fresh)
        else:
            np.minimum.at(kept, place[free], value[free])
        full = (kept.reshape(n, bins) != top).all(axis=1)
        go_on = ~full[doc]
        active, doc = active[go_on], doc[go_on]
    kept[kept == top] = 0
    return (kept & _U(0xFFFF)).astype(np.uint16).reshape(n, bins)


def fingerprint(own: np.ndarray) -> bytes:
    """128 bits of a whole set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The sizes of the intersection and the union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0, len(large)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both, len(a) + len(b) - both
