"""What the corpus operators share: tables staged in the cluster's shared folder, byte files there, Arrow text helpers."""

from __future__ import annotations

import ctypes
import functools
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import ship_package

#: The white space of every contract here: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is absent (tests, one machine) a temporary folder
    is made and set, so that later calls find it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found if "://" in found or not found.startswith("file:") else "file://" + found.removeprefix("file:")


def fresh_folder(spark: SparkSession, name: str) -> str:
    ship_package(spark)
    return f"{shared_folder(spark).rstrip('/')}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows go to the Python workers in batches of about so many bytes.
BATCH_BYTES = 4 << 20


def through(df: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in batches of bounded size: Spark's own bound of 64 MB counts twice, in the executor and in the worker."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(made, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What frees the memory of operators that remember things in a worker; which operator this worker serves.
forgets: list[Callable[[], None]] = []
_served: list[str] = [""]


def serves(operator: str) -> None:
    """A worker process serves many operators, one after the other: what one remembers goes when another begins."""
    if _served[0] != operator:
        _served[0] = operator
        for forget in forgets:
            forget()
        give_back()


@functools.cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda kept: 0)


def give_back() -> None:
    """Returns freed memory to the system: glibc and Arrow's pool keep it otherwise, for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def named(column: str) -> Column:
    """A column by its very name, which may have dots and backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


#: A range-partitioned sort has a partition for every so many bytes of its input, and the session's shuffle partitions at least.
PARTITION_BYTES = 64 << 20


def sort_partitions(df: DataFrame) -> int:
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # Without statistics Spark tells a size beyond any table's.
    known = -(-size // PARTITION_BYTES) if size < 1 << 60 else 1
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + posixpath.abspath(uri))


def write_once(uri: str, pieces: Iterator[bytes]) -> None:
    """Writes a file under a private name, then renames it: a retried task replaces whole files only."""
    files, path = file_system(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    private = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(private) as out:
        for piece in pieces:
            out.write(piece)
    files.move(private, path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2] if len(column) else None
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bytes_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.Array.from_buffers(kind or pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of the given column, a longer text alone in its slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
            give_back()
    give_back()
