"""Exact deduplication by a content sort.

Sampled splitters range-partition the normalised texts, an external sort by their
whole bytes places equal texts side by side, and a full comparison of neighbours
finds the runs. A run can go on in the next partition; those runs, at most two for
each partition, are put together in a second small step.

Texts are equal when identical after deleting blanks, tabs, line feeds, vertical
tabs, form feeds and carriage returns. Of equal texts the row with the most code
points in its original text stays, then the smallest id.

The splitters are truncated: Spark collects its sample of the range key on the
driver, so the key has the first `PREFIX` bytes of the normalised text only, and
breaks ties by its SHA-256, the code points, the id and a hash of the original
text. These spread texts with a common beginning, and one group of copies however
large, over many partitions. Within a partition the order is that of the whole
normalised bytes, then code points, id and that hash. Only the texts with the
smallest and the largest key of a partition can go on in another one; each
partition tells them.

Defined results: a null text counts as empty; all empty texts are one group; a
null id sorts after all others; rows that repeat an id count one by one, of rows
that repeat id and text one stays; an empty table gives an empty result; other
columns of the input pass through and may carry any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

PREFIX = 64

#: `_td_mark` rows name a text that may go on in another partition; all others are rows of the input.
_DECISION = "_td_id long, _td_sha string, _td_part int, _td_mark boolean, _td_first boolean, _td_size long, _td_keep long"
_NAMES = [field.split()[0] for field in _DECISION.split(", ")]


def _normalised(text):
    for space in (" ", "\t", "\n", "\x0b", "\f", "\r"):
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def _edge_keys(norm: pa.Array, sha: pa.Array) -> tuple[tuple[bytes, str], tuple[bytes, str]]:
    """The smallest and the largest (beginning, SHA-256) of rows in the order of their bytes."""
    begin = pc.binary_slice(norm, 0, PREFIX)
    low, high = begin[0].as_py(), begin[len(begin) - 1].as_py()
    return (low, pc.min(sha.filter(pc.equal(begin, low))).as_py()), (high, pc.max(sha.filter(pc.equal(begin, high))).as_py())


def _runs(batches: Iterator[pa.RecordBatch], leaders_only: bool) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted partition.

    Holds the ids of the open run only. With `leaders_only` each run gives its
    first row with all columns; otherwise each row gives its decision.
    """
    shared.serves("exact")
    part = TaskContext.get().partitionId()
    last_text, low, high = None, None, None
    open_rows: list[pa.RecordBatch] = []
    held, extra, kinds = 0, [], []

    def decided(rows: pa.RecordBatch, first: np.ndarray, size: np.ndarray, keep: pa.Array) -> pa.RecordBatch:
        n = rows.num_rows
        made = [rows.column("_td_id"), rows.column("_td_sha"), pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, bool)), pa.array(first), pa.array(size), keep]
        return pa.RecordBatch.from_arrays(made + [rows.column(c) for c in extra], names=_NAMES + extra)

    def closed() -> Iterator[pa.RecordBatch]:
        keep = open_rows[0].column("_td_id")[0].as_py()
        for k, rows in enumerate(open_rows):
            first = np.zeros(rows.num_rows, bool)
            first[0] = k == 0
            yield decided(rows, first, np.full(rows.num_rows, held, np.int64), pa.array([keep] * rows.num_rows, pa.int64()))

    for batch in shared.bounded(batches, "_td_norm", 2 << 20):
        n, norm = batch.num_rows, batch.column("_td_norm")
        extra = [c for c in batch.schema.names if leaders_only and c not in ("_td_id", "_td_sha", "_td_norm")]
        kinds = [batch.schema.field(c).type for c in extra]
        same = np.zeros(n, dtype=bool)
        same[0] = last_text is not None and norm[0].as_py() == last_text
        if n > 1:
            same[1:] = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        last_text = norm[n - 1].as_py()
        ends = _edge_keys(norm, batch.column("_td_sha"))
        low, high = (ends[0] if low is None else min(low, ends[0])), (ends[1] if high is None else max(high, ends[1]))
        rows = batch.select(["_td_id", "_td_sha", *extra])
        starts = np.flatnonzero(~same)
        if not len(starts):
            held += n
            if not leaders_only:
                open_rows.append(rows)
            continue
        if starts[0] > 0:
            held += int(starts[0])
            if not leaders_only:
                open_rows.append(rows.slice(0, starts[0]))
        if open_rows:
            yield from closed()
        # Whole runs inside this batch but for its last one.
        if len(starts) > 1:
            lo, hi = int(starts[0]), int(starts[-1])
            sizes = np.diff(starts)
            of = np.arange(len(sizes)) if leaders_only else np.repeat(np.arange(len(sizes)), sizes)
            at = starts[:-1] if leaders_only else np.arange(lo, hi)
            first = np.isin(at, starts)
            yield decided(rows.take(pa.array(at)), first, sizes[of].astype(np.int64), rows.column("_td_id").take(pa.array(starts[:-1][of])))
        tail = int(starts[-1])
        held = n - tail
        open_rows = [rows.slice(tail, 1 if leaders_only else n - tail)]
    if open_rows:
        yield from closed()
        marks = sorted({low[1], high[1]})
        none = [pa.nulls(len(marks), kind) for kind in (pa.bool_(), pa.int64(), pa.int64(), *kinds)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(marks), pa.int64()), pa.array(marks), pa.array([part] * len(marks), pa.int32()), pa.array([True] * len(marks)), *none], names=_NAMES + extra)


def _sorted(docs: DataFrame, id_col: str, text_col: str, carried: list[Column]) -> DataFrame:
    """_td_id, _td_sha, _td_norm (the normalised bytes) and `carried` as _in_0, _in_1, ... in the order of the bytes."""
    text = F.coalesce(shared.named(text_col), F.lit(""))
    rows = docs.select(shared.named(id_col).cast("long").alias("_td_id"), text.alias("_td_text"), *[c.alias(f"_in_{i}") for i, c in enumerate(carried)])
    norm = _normalised(F.col("_td_text")).cast("binary")
    keyed = rows.select("*", norm.alias("_td_norm"), F.char_length("_td_text").alias("_td_chars"), F.xxhash64("_td_text").alias("_td_hash"))
    keyed = keyed.select("*", F.substring("_td_norm", 1, PREFIX).alias("_td_prefix"), F.sha2("_td_norm", 256).alias("_td_sha")).drop("_td_text", *["_td_norm"] * bool(carried))
    ties = [F.col("_td_chars").desc(), F.col("_td_id").asc_nulls_last(), F.col("_td_hash")]
    dealt = keyed.repartitionByRange(shared.sort_partitions(docs), "_td_prefix", "_td_sha", *ties)
    if carried:
        # The text travels among the carried columns; its normalised form is made again.
        own = F.coalesce(F.col(f"_in_{docs.columns.index(text_col)}"), F.lit(""))
        dealt = dealt.withColumn("_td_norm", _normalised(own).cast("binary"))
    return dealt.sortWithinPartitions("_td_norm", *ties).drop("_td_prefix", "_td_chars", "_td_hash")


def _edges(runs: DataFrame) -> DataFrame:
    """One row for each text that may lie in several partitions: at most two for each partition, so small enough to broadcast."""
    marked = runs.where("_td_mark").select(F.col("_td_sha").alias("_e_sha")).distinct()
    led = runs.where("_td_first").join(F.broadcast(marked), F.col("_td_sha") == F.col("_e_sha"))
    return led.groupBy("_e_sha").agg(F.sum("_td_size").alias("_all_size"), F.min_by("_td_keep", "_td_part").alias("_all_keep"), F.min("_td_part").alias("_all_part"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = shared.staged(shared.through(_sorted(docs, id_col, text_col, []), lambda it: _runs(it, False), _DECISION), "exact-runs")
    whole = runs.where("NOT _td_mark").join(F.broadcast(_edges(runs)), F.col("_td_sha") == F.col("_e_sha"), "left")
    inner = F.col("_e_sha").isNull()
    return whole.select(
        F.col("_td_id").alias("doc_id"),
        F.when(inner, F.col("_td_keep")).otherwise(F.col("_all_keep")).alias("keep_id"),
        F.coalesce("_all_size", "_td_size").alias("group_size"),
        (F.col("_td_first") & (inner | (F.col("_td_part") == F.col("_all_part")))).alias("kept"),
        F.col("_td_sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of the input."""
    fields = [T.StructField(f"_in_{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    schema = T.StructType([*T._parse_datatype_string(_DECISION).fields, *fields])
    rows = _sorted(docs, id_col, text_col, [shared.named(c) for c in docs.columns])
    leaders = shared.staged(shared.through(rows, lambda it: _runs(it, True), schema), "exact-leaders")
    later = _edges(leaders).select("_e_sha", "_all_part")
    elsewhere = (F.col("_td_sha") == F.col("_e_sha")) & (F.col("_td_part") != F.col("_all_part"))
    stay = leaders.where("NOT _td_mark").join(F.broadcast(later), elsewhere, "left_anti")
    return stay.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])
