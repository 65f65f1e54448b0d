"""Token-id files with a keyed index.

A shard holds the ids of some documents in ascending order of their ids:

    payload   token ids, one after the other, 2 or 4 bytes each, little-endian
    keys      the document id of each entry (int64), then one byte each: 1 where the id is null
    offsets   where each entry's tokens begin in the payload (uint64, entries + 1)
    index     a minimal perfect hash of the distinct keys, and for each of its slots
              a fingerprint of the key (uint32) and the key's first entry (uint32)
    trailer   the place of each part, and the file's mark

The minimal perfect hash keeps bit arrays level by level: keys that hash alone to
a place of a level set its bit, the others go on to the next level. A key's slot is
the number of set bits before its own. Finding a key takes about 1.6 hashes, one
fingerprint and one offset, whatever the size of the shard. Rows that repeat an id
lie side by side; the index leads to the first.

Shards are cut by ascending id; a hash of the text and a random number break ties,
so an id that repeats, or a null one, spreads over as many shards as its rows fill.
The table that `write` returns is the index over all shards: first and last key of
each. `lookup` goes by it to the shards that may hold a key, and there to the
entry in constant time.

The files are written where the cluster's shared folder is, one by each task,
under a private name first, so a lost executor leaves no half file behind.

Defined results: a null or empty text has no tokens but the end id; a null document
id sorts first and is in the file but not in the index; rows that repeat an id are
entries of their own, of which a lookup gives the first; an empty table gives no
file; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, shared

MARK = b"TDTOKEN1"
_TRAILER = struct.Struct("<QQQQQQQ8s")
#: Places for each key of a level; levels before the keys that are left are listed outright.
GAMMA, LEVELS = 2.0, 32


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of each key (multiply and shift, as in SplitMix64)."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flags = np.unpackbits(bits, bitorder="little")[: int(self.bases[-1])].astype(bool) if len(bits) else np.zeros(0, bool)
        self.flags, self.ranks = flags, np.concatenate([[0], np.cumsum(flags)]).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys.astype(np.int64)
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(len(left) * GAMMA))
            place = (mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
        flags = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flags, bitorder="little"), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Of keys that are in the set, their slots; of others any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ones = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_ones):
                return out
            place = self.bases[level] + (mixed(keys[open_ones], level) % np.uint64(size)).astype(np.int64)
            hit = self.flags[place]
            out[open_ones[hit]] = self.ranks[place[hit]]
            open_ones = open_ones[~hit]
        if len(open_ones) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_ones]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_ones]
            out[open_ones[found]] = self.ranks[-1] + at[found]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQ", len(self.sizes), len(self.bits), len(self.rest)) + self.sizes.tobytes() + self.rest.tobytes() + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        a, b, c = struct.unpack_from("<QQQ", data)
        sizes = np.frombuffer(data, np.int64, a, 24)
        rest = np.frombuffer(data, np.int64, c, 24 + 8 * a)
        return cls(sizes, np.frombuffer(data, np.uint8, b, 24 + 8 * a + 8 * c), rest), 24 + 8 * a + 8 * c + b


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 101) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: np.ndarray, null: np.ndarray) -> bytes:
    entries = np.flatnonzero(~null)
    distinct, first = np.unique(keys[entries], return_index=True)
    table = PerfectHash.of(distinct)
    slots = table.slots(distinct)
    prints, where = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
    prints[slots] = fingerprints(distinct)
    where[slots] = entries[first]
    return table.to_bytes() + prints.tobytes() + where.tobytes()


class Shard:
    """Reads one file: keyed access, or all entries in order."""

    def __init__(self, uri: str):
        files, path = shared.file_system(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(_TRAILER.size, size - _TRAILER.size)
        self.width, keys_at, offsets_at, index_at, self.entries, self.tokens, _, mark = _TRAILER.unpack(tail)
        if mark != MARK:
            raise ValueError(f"{uri} is no token file")
        self.keys = np.frombuffer(self.file.read_at(8 * self.entries, keys_at), np.int64)
        self.null = np.frombuffer(self.file.read_at(self.entries, keys_at + 8 * self.entries), np.uint8).astype(bool)
        self.offsets = np.frombuffer(self.file.read_at(8 * (self.entries + 1), offsets_at), np.uint64).astype(np.int64)
        index = self.file.read_at(size - _TRAILER.size - index_at, index_at)
        self.table, used = PerfectHash.from_bytes(index)
        n = (len(index) - used) // 8
        self.prints = np.frombuffer(index, np.uint32, n, used)
        self.where = np.frombuffer(index, np.uint32, n, used + 4 * n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first entry of each key, or -1."""
        slots = self.table.slots(keys)
        found = np.full(len(keys), -1, np.int64)
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == fingerprints(keys[ok])
        found[ok] = self.where[slots[ok]]
        # A fingerprint can agree by chance: the key has the last word.
        ok[ok] = self.keys[found[ok]] == keys[ok]
        return np.where(ok, found, -1)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Tokens of the entries from `first` up to `last`, as unsigned 32-bit numbers."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}").astype("<u4")

    def get(self, key: int) -> np.ndarray | None:
        at = self.find(np.array([key], np.int64))[0]
        return None if at < 0 else self.ids(at, at + 1)


def _written(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    shared.serves("token files")
    part = TaskContext.get().partitionId()
    encoder = chunks.library_encoder(path)
    keys, null, lengths = [], [], []

    def pieces() -> Iterator[bytes]:
        for batch in shared.bounded(batches, "text", 2 << 20):
            ids, begins = chunks.with_end(*encoder.encode(batch.column("text")), end_id)
            column = batch.column("doc_id")
            null.append(column.is_null().to_numpy(zero_copy_only=False))
            keys.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            lengths.append(np.diff(begins))
            yield ids.astype(f"<u{width}").tobytes()
        if not keys:
            return
        k, z, n = np.concatenate(keys), np.concatenate(null), np.concatenate(lengths)
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.uint64)
        keys_at = int(offsets[-1]) * width
        offsets_at = keys_at + 9 * len(k)
        index_at = offsets_at + 8 * len(offsets)
        yield k.tobytes() + z.astype(np.uint8).tobytes() + offsets.tobytes() + index_bytes(k, z)
        yield _TRAILER.pack(width, keys_at, offsets_at, index_at, len(k), int(offsets[-1]), 0, MARK)

    stream = pieces()
    first = next(stream, None)
    if first is None:
        return
    uri = f"{folder}/shard-{part:06d}.tokens"

    def chained() -> Iterator[bytes]:
        yield first
        yield from stream

    shared.write_once(uri, chained())
    real = np.concatenate(keys)[~np.concatenate(null)]
    ends = [pa.array([int(real[i])] if len(real) else [None], pa.int64()) for i in (0, -1)]
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), *ends, pa.array([sum(map(len, keys))], pa.int64()), pa.array([int(sum(x.sum() for x in lengths))], pa.int64())], names=["part", "uri", "first_key", "last_key", "n_docs", "n_tokens"])


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards in ascending order of the ids; one row for each: part, uri, first_key, last_key, n_docs, n_tokens."""
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    path = chunks.shipped(docs.sparkSession, path)
    rows = docs.select(shared.named(id_col).cast("long").alias("doc_id"), F.coalesce(shared.named(text_col), F.lit("")).alias("text"))
    order = F.col("doc_id").asc_nulls_first()
    dealt = rows.repartitionByRange(shared.sort_partitions(rows), order, F.xxhash64("text"), F.rand(17)).sortWithinPartitions(order)
    schema = "part int, uri string, first_key long, last_key long, n_docs long, n_tokens long"
    return shared.staged(shared.through(dealt, lambda it: _written(it, folder, path, end_id, width), schema), "token-shards")


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, uri, k), shard after shard, to (doc_id, part, ids) of the keys that the shards have."""
    opened, shard = None, None
    for batch in batches:
        uris, keys = batch.column("uri").to_pylist(), batch.column("k").to_numpy()
        cuts = [0, *(i for i in range(1, len(uris)) if uris[i] != uris[i - 1]), len(uris)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if opened != uris[a]:
                opened, shard = uris[a], Shard(uris[a])
            found = shard.find(keys[a:b])
            have = np.flatnonzero(found >= 0)
            ids = [shard.ids(i, i + 1).astype(np.int64) for i in found[have].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:b][have]), batch.column("part").slice(a, b - a).take(pa.array(have)), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "part", "ids"])


def lookup(shards: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of the distinct keys that the written shards hold.

    The ranges of shards do not overlap but at their edges, so the range join finds about one shard a key. Keys are dealt by
    shard and a hash, so many keys of one shard are read by several tasks, each of which opens it once.
    """
    wanted = keys.select(shared.named(key_col).cast("long").alias("k")).where("k IS NOT NULL").distinct()
    # One row for each shard, that is for each partition that was written.
    near = wanted.join(F.broadcast(shards.select("part", "uri", "first_key", "last_key")), F.col("k").between(F.col("first_key"), F.col("last_key")))
    asked = near.select("part", "uri", "k").repartition("part", F.pmod(F.xxhash64("k"), F.lit(64))).sortWithinPartitions("part")
    found = shared.through(asked, _looked_up, "doc_id long, part int, ids array<long>")
    return found.groupBy("doc_id").agg(F.min_by("ids", "part").alias("ids"))


def get(shards: DataFrame, key: int) -> np.ndarray | None:
    """The tokens of one document out of all shards, or None."""
    for row in shards.where(F.lit(key).between(F.col("first_key"), F.col("last_key"))).orderBy("part").select("uri").toLocalIterator():
        found = Shard(row["uri"]).get(key)
        if found is not None:
            return found
    return None


def _entries(batches: Iterator[pa.RecordBatch], block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["uri"])
            # Every key goes through the index; what it finds must be the key's first entry.
            real = np.flatnonzero(~shard.null)
            found = shard.find(shard.keys[real])
            first = np.searchsorted(shard.keys[real], shard.keys[real], side="left")
            if not np.array_equal(found, real[first]):
                raise ValueError(f"the index of {row['uri']} does not lead to its entries")
            at = 0
            while at < shard.entries:
                last = max(at + 1, int(np.searchsorted(shard.offsets, shard.offsets[at] + block, side="right")) - 1)
                ids, base = shard.ids(at, last), int(shard.offsets[at])
                cut = shard.offsets[at : last + 1] - base
                crc = [zlib.crc32(ids[cut[i] : cut[i + 1]]) for i in range(last - at)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.keys[at:last], mask=shard.null[at:last]), pa.array(row["start"] + shard.offsets[at:last]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                at = last


def read(shards: DataFrame) -> DataFrame:
    """Every entry of the shards that `write` returned: doc_id, start, n_tokens, ids_crc32.

    The driver holds one row for each shard, that is for each partition, to sum up where each begins.
    """
    spark = shards.sparkSession
    told = sorted(shards.collect())
    starts = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in told])]).tolist()
    rows = [(r["uri"], s) for r, s in zip(told, starts, strict=False)]
    listed = spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "uri string, start long")
    return shared.through(listed, _entries, "doc_id long, start long, n_tokens long, ids_crc32 long")
