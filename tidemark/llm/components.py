"""Connected components of a graph too large for one machine: alternating large-star and small-star steps.

What is left of it is put together by one task as soon as it has no more than `TASK_EDGES` edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MOST_ROUNDS = 40
#: Edges that a task puts together at a time, some 40 MB there.
TASK_EDGES = 1 << 17


class Union:
    """Union-find over numbers from 0; a root is the smallest of its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contracted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The edges of a task, `most` and a batch at a time, as a star for each of their components."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in (0, 1)])
        n += batch.num_rows
        if n > most:
            yield _stars(held)
            held, n = [], 0
    if held:
        yield _stars(held)


def _stars(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    u, v = (np.concatenate(ends) for ends in zip(*held, strict=True))
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    sets = Union(len(nodes))
    for a, b in zip(where[: len(u)].tolist(), where[len(u) :].tolist(), strict=True):
        sets.join(a, b)
    root = np.fromiter(map(sets.root, range(len(nodes))), np.int64, len(nodes))
    far = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["u", "v"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the smallest node of its component) of every node that has an edge and is no root.

    edges: columns u and v (long). Each step first gathers minima with partial
    aggregation and joins staged tables, so a node with very many edges is split.
    """

    def step(rows: DataFrame, large: bool) -> DataFrame:
        both = rows if not large else rows.select("u", "v").union(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = shared.staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "node"), f"{name}-least")
        joined = both.join(least, both.u == least.node)
        if large:
            return joined.where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Each node's smaller neighbours, and the node itself, go to the smallest of them.
        return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("node > m").select(F.col("node").alias("u"), F.col("m").alias("v")))

    def settled(rows: DataFrame) -> bool:
        """Every node has one edge, and what it leads to has none: each component is a star around its root."""
        if not rows.groupBy("u").count().where("count > 1").isEmpty():
            return False
        roots = rows.select(F.col("v").alias("w")).distinct()
        return rows.join(roots, F.col("u") == F.col("w"), "left_semi").isEmpty()

    most = TASK_EDGES

    def contracted(rows: DataFrame, k: int) -> DataFrame:
        return shared.staged(shared.through(rows, lambda it: _contracted(it, most), "u long, v long"), f"{name}-{k}")

    rows = contracted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), 0)
    for k in range(1, MOST_ROUNDS):
        if rows.count() <= most:
            rows = contracted(rows.coalesce(1), k)
            break
        # Tasks may have told the same edge.
        rows = shared.staged(rows.distinct(), f"{name}-{k}") if k == 1 else rows
        if settled(rows):
            break
        rows = shared.staged(step(rows, True).distinct(), f"{name}-{k}-large")
        rows = shared.staged(step(rows, False).distinct(), f"{name}-{k}-small")
    else:
        raise RuntimeError("components did not settle")
    return rows.select(F.col("u").alias("node"), F.col("v").alias("root"))
