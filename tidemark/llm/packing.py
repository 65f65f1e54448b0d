"""Packing of documents into sequences.

A document's ids are cut at every multiple of the sequence length; all its pieces
but the last fill a sequence each. The last pieces are packed by first-fit
decreasing: in descending order of length each goes to the first sequence with
room. A tournament tree over the sequences holds the largest room below each
node, so the first sequence with room is found by walking down from the root.

Documents are dealt to groups by a seeded hash of their id and their content, and
each group is packed on its own, in an order that id and content give. Nothing
depends on where a row lies, so the same table gives the same sequences however
it is partitioned. A group has `GROUP_DOCS` documents on average and its tree a
few tens of kilobytes, so work and memory for each task do not grow with the
corpus; first-fit decreasing leaves about one poorly filled sequence for each
group. Rows that repeat both id and content are counted before the shuffle and
dealt as numbered copies, so they spread over the groups as well.

Only lengths and checksums travel to the groups, never ids: a cut does not depend
on what else is in a sequence.

Defined results: a null or empty text has only the end id; rows that repeat an id,
or an id and its text, are packed as documents of their own; a null id forms
pieces like any other; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks, shared

#: Texts are encoded in slices of so many bytes, at some 100 bytes of arrays a byte.
SLICE_BYTES = 1 << 19
GROUP_DOCS = 4_000
LEAST_GROUPS = 8
SEED = 20_481


class Tournament:
    """Leaves are sequences with their room; each inner node has the larger room of its two children."""

    def __init__(self, leaves: int, room: int):
        self.size = 1
        while self.size < max(1, leaves):
            self.size *= 2
        self.most = [room] * (2 * self.size)

    def first_with(self, need: int) -> int:
        at = 1
        while at < self.size:
            at *= 2
            if self.most[at] < need:
                at += 1
        return at - self.size

    def take(self, leaf: int, need: int) -> int:
        """Takes the room; what was used before."""
        at = leaf + self.size
        most = self.most
        self_room = most[at]
        most[at] = self_room - need
        while at > 1:
            at //= 2
            larger = max(most[2 * at], most[2 * at + 1])
            if most[at] == larger:
                break
            most[at] = larger
        return self_room


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece and its place there."""
    order = np.argsort(-lengths, kind="stable")
    tree = Tournament(len(lengths), room)
    where, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        leaf = tree.first_with(need)
        where[i], place[i] = leaf, room - tree.take(leaf, need)
    return where, place


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, room: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    shared.serves("packing")
    encoder = chunks.library_encoder(path)
    for batch in shared.bounded(batches, "text", SLICE_BYTES):
        ids, begins = chunks.with_end(*encoder.encode(batch.column("text")), end_id)
        sizes = np.diff(begins)
        prints = np.fromiter((xxhash.xxh64_intdigest(ids[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)), np.uint64, len(sizes)).view(np.int64)
        count = -(-sizes // room)
        doc = np.repeat(np.arange(len(sizes)), count)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = within * room
        length = np.minimum(room, sizes[doc] - start)
        at = begins[doc] + start
        crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(prints[doc]), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc])]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + length[-1]).astype(np.int32)), pa.array(ids.astype(np.int64))))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_print", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])


def _packed(group: pa.Table, room: int) -> pa.Table:
    """Sequences of one group, numbered from 0: first the full pieces', then those of first-fit decreasing."""
    group = group.sort_by([(c, "ascending") for c in ("doc_id", "_print", "_copy", "start")])
    length = group.column("length").to_numpy()
    full = length == room
    where, place = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    where[full] = np.arange(full.sum())
    if (~full).any():
        inside, at = first_fit_decreasing(length[~full], room)
        where[~full], place[~full] = full.sum() + inside, at
    # A group's number is in the high bits: no two groups share a sequence.
    sequence = (group.column("_group").to_numpy().astype(np.int64) << 40) + where
    return group.drop_columns(["_print", "_copy", "_group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(place))


def pack(docs: DataFrame, path: str, end_id: int, room: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document with their sequence and place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = chunks.shipped(docs.sparkSession, path)
    rows = docs.select(shared.named(id_col).cast("long").alias("doc_id"), F.coalesce(shared.named(text_col), F.lit("")).alias("text"))
    extra = ", ids array<long>" * with_ids
    made = shared.through(rows, lambda it: _pieces(it, path, end_id, room, with_ids), "doc_id long, _print long, start long, length long, ids_crc32 long, doc_tokens long" + extra)
    pieces = shared.staged(made, "pieces")
    count = pieces.where("start = 0").count()
    groups = max(LEAST_GROUPS, -(-count // GROUP_DOCS))
    same = [F.first(c).alias(c) for c in ("length", "ids_crc32", "doc_tokens", *["ids"] * with_ids)]
    alike = pieces.groupBy("doc_id", "_print", "start").agg(*same, F.count("*").alias("_copies"))
    copies = alike.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).drop("_copies")
    # All pieces of a document have its id, print and copy, and so its group.
    dealt = copies.withColumn("_group", F.pmod(F.xxhash64("doc_id", "_print", "_copy", F.lit(SEED)), F.lit(groups)))
    columns = ["doc_id", "_print", "_copy", "_group", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + extra + ", sequence_id long, offset long"
    return dealt.select(*columns).groupBy("_group").applyInArrow(lambda g: _packed(g, room), schema)
