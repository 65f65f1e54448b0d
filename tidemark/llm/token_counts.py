"""Token counts of documents in flat token files without an index.

A flat file is nothing but token ids, little-endian, 2 bytes each or 4 where the
vocabulary has more than 65,536 entries, every document followed by an end id.
Documents may begin in one block and end in another, and go on over any number of
blocks or files.

Each block is searched for the end id in one vectorised comparison. That gives
the documents that end in it, and where its last end lies. A prefix scan over the blocks, in
order, then tells how many documents ended before each block and how many ids of
an unfinished document it is handed. The scan has two levels: `SPAN` consecutive
blocks of a file are scanned by a window on the executors; the driver holds three
numbers for each span (4 GB of tokens, or a whole smaller file) and adds those up.

Texts are encoded with strings of special entries as ordinary text, so that none
of them looks like an end.

Defined results: ids after the last end form a last document without an end
(`ended` is false); a file may be empty; two ends side by side enclose a document
of one token, its end. A null or empty text has its end alone; rows with a null
id, and rows that repeat an id, are documents of their own; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks, shared

BLOCK = 4 << 20
#: Blocks of a span; blocks that one task scans.
SPAN, TASK_BLOCKS = 1024, 8


def _flat(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    shared.serves("token counts")
    part = TaskContext.get().partitionId()
    encoder = chunks.library_encoder(path, plain=True)
    told, tokens = [], 0

    def pieces() -> Iterator[bytes]:
        nonlocal tokens
        for batch in shared.bounded(batches, "text", 2 << 20):
            ids, _ = chunks.with_end(*encoder.encode(batch.column("text")), end_id)
            told.append(batch.column("doc_id"))
            tokens += len(ids)
            yield ids.astype(f"<u{width}").tobytes()

    uri = f"{folder}/flat-{part:06d}.bin"
    shared.write_once(uri, pieces())
    row = 0
    for column in told:
        n = len(column)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array([uri] * n), pa.array(np.arange(row, row + n)), column, pa.array(np.full(n, width * tokens))], names=["part", "uri", "place", "doc_id", "bytes"])
        row += n


def id_width(path: str, end_id: int) -> int:
    """Bytes of an id in the flat files of a vocabulary."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def write_flat(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes documents to flat files, a file a partition; one row a document: part, uri, place, doc_id, bytes of the file."""
    width = id_width(path, end_id)
    path = chunks.shipped(docs.sparkSession, path)
    rows = docs.select(shared.named(id_col).cast("long").alias("doc_id"), F.coalesce(shared.named(text_col), F.lit("")).alias("text"))
    return shared.staged(shared.through(rows, lambda it: _flat(it, folder, path, end_id, width), "part int, uri string, place long, doc_id long, bytes long"), "flat-files")


def _block_ids(row: dict, width: int) -> np.ndarray:
    files, path = shared.file_system(row["uri"])
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read_at(row["stop"] - row["start"], row["start"]), f"<u{width}")


def _searched(batches: Iterator[pa.RecordBatch], end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    """Of each block how many ends it has, and the place in its file behind the last one (null without any)."""
    for batch in batches:
        ends, behind = [], []
        for row in batch.to_pylist():
            at = np.flatnonzero(_block_ids(row, width) == end_id)
            ends.append(len(at))
            behind.append(row["start"] // width + int(at[-1]) + 1 if len(at) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.int64()), pa.array(behind, pa.int64())], names=[*batch.schema.names, "ends", "behind"])


def _measured(batches: Iterator[pa.RecordBatch], end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    """The documents that end in each block; of the last block also what is left without an end."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = _block_ids(row, width)
            sizes = np.diff(np.flatnonzero(ids == end_id), prepend=-1)
            left = len(ids) - int(sizes.sum()) + (0 if len(sizes) else row["carried"])
            if len(sizes):
                sizes[0] += row["carried"]
            place = row["before"] + np.arange(len(sizes))
            ended = np.ones(len(sizes), bool)
            if row["last"] and left:
                sizes, place, ended = np.append(sizes, left), np.append(place, row["before"] + len(place)), np.append(ended, False)
            if len(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(ended)], names=["ordinal", "n_tokens", "ended"])


def count_tokens(spark: SparkSession, files: list[tuple[str, int]], end_id: int, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Documents of flat files read as one stream in the given order: ordinal, n_tokens (with the end), ended.

    files: place and size in bytes of each; `width` bytes an id. The driver holds a row for each file and span.
    """
    counts = "ordinal long, n_tokens long, ended boolean"
    block = max(width, block - block % width)
    told = [(k, uri, size) for k, (uri, size) in enumerate(files) if size]
    if not told:
        return spark.createDataFrame([], counts)
    n = sum(-(-size // block) for _, _, size in told)
    listed = spark.createDataFrame(told, "file long, uri string, size long")
    blocks = listed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {block}"))))
    blocks = blocks.select("file", "uri", "k", (F.col("k") * block).alias("start"), F.least(F.col("size"), (F.col("k") + 1) * block).alias("stop"))
    dealt = blocks.repartition(max(1, -(-n // TASK_BLOCKS)))
    schema = "file long, uri string, k long, start long, stop long, ends long, behind long"
    found = shared.staged(shared.through(dealt, lambda it: _searched(it, end_id, width), schema), "block-ends").withColumn("span", F.expr(f"k div {SPAN}"))
    # The upper level: how many documents ended before each span, and where in the whole stream the open one began.
    spans = sorted(tuple(r) for r in found.groupBy("file", "span").agg(F.sum("ends"), F.max("behind"), F.sum(F.col("stop") - F.col("start"))).collect())
    before = opened = stream = 0
    at, carry = {}, []
    for file, span, ends, behind, size in spans:
        first = at.setdefault(file, stream)
        # Where the open document began, counted in ids from the start of this file.
        carry.append((file, span, before, opened - first))
        before += ends
        opened = first + behind if behind is not None else opened
        stream += size // width
    upper = spark.createDataFrame(carry, "file long, span long, before_span long, opened_span long")
    w = Window.partitionBy("file", "span").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    lower = found.withColumn("e", F.coalesce(F.sum("ends").over(w), F.lit(0))).withColumn("b", F.max("behind").over(w))
    both = lower.join(F.broadcast(upper), ["file", "span"])
    scanned = both.select(
        "uri", "start", "stop", (F.col("before_span") + F.col("e")).alias("before"), (F.expr(f"start div {width}") - F.coalesce("b", "opened_span")).alias("carried"), ((F.col("file") == told[-1][0]) & (F.col("stop") == told[-1][2])).alias("last")
    )
    return shared.through(scanned.repartition(max(1, -(-n // TASK_BLOCKS))), lambda it: _measured(it, end_id, width), counts)


def documents_counted(docs: DataFrame, path: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """Writes documents flat, counts them again by the scan alone, and puts the ids back: doc_id, ordinal, n_tokens."""
    spark = docs.sparkSession
    listed = write_flat(docs, shared.fresh_folder(spark, "flat"), path, end_id)
    files = sorted((r["part"], r["uri"], r["bytes"], r["n"]) for r in listed.groupBy("part", "uri", "bytes").agg(F.count("*").alias("n")).collect())
    counts = count_tokens(spark, [(uri, size) for _, uri, size, _ in files], end_id, block, id_width(path, end_id))
    firsts, at = [], 0
    for part, _, _, n in files:
        firsts.append((part, at))
        at += n
    # A row for each file: as many as there are partitions.
    base = F.broadcast(spark.createDataFrame(firsts, "part int, first long"))
    return listed.join(base, "part").select("doc_id", (F.col("first") + F.col("place")).alias("ordinal")).join(counts, "ordinal").select("doc_id", "ordinal", "n_tokens")
