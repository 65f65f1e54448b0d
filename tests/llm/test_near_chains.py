"""Links between documents that are held against unlike centres."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_dedup, queries


def _chains(rng, chains=10, length=25, words=150, edits=2):
    """Texts that drift: each is linked with the few before and after it in its chain only."""
    rows = []
    for c in range(chains):
        text = [f"c{c}_{k}" for k in range(words)]
        for i in range(length):
            rows.append(" ".join(text))
            for _ in range(edits):
                text[rng.randrange(words)] = f"e{c}_{i}_{rng.random()}"
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def chained():
    return _chains(random.Random(250))


def test_op1_ties_chains_of_documents(spark, docs, chained, tmp_path):
    spark.createDataFrame(chained, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op1_near_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute.near(chained, 85).items()}


def test_near_stage_keeps_one_of_each_chain(spark, docs, chained):
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    stay = {r["doc_id"] for r in stage(spark, spark.createDataFrame(chained, "doc_id long, text string"), "").collect()}
    assert stay == {i for i, (_, c) in brute.near(chained, 80).items() if i == c} and len(stay) == 10


def test_bucket_rows_of_unlike_centres_share_a_cluster(spark, docs):
    """x and y agree in 141 bins; in each bucket they share, x is near the first round's centre only, y near the second's only."""
    ids = spark.range(1, 200).select("id", F.xxhash64("id", F.lit(0)).alias("a"), F.xxhash64("id", F.lit(1)).alias("b")).collect()
    first = min(ids, key=lambda r: r["a"])["id"]
    second, x, y = sorted((r for r in ids if r["id"] != first), key=lambda r: r["b"])[:3]
    second, x, y = second["id"], x["id"], y["id"]
    bands = near_dedup.BINS // near_dedup.ROWS
    # Nine bands are common to all four; in the others x and y differ in one bin of four.
    sx = np.arange(near_dedup.BINS, dtype=np.uint16).reshape(bands, -1)
    sy = sx.copy()
    sy[9:, 0] += 1000
    c0, c1 = sx + np.uint16(2000), sx + np.uint16(3000)
    c0[:9], c1[:9] = sx[:9], sx[:9]
    # Besides, one centre has x's and the other y's own bins, each with one more bin of some bands.
    c0[9:, 0], c0[9:20, 1] = sx[9:, 0], sx[9:20, 1]
    c1[9:, 0], c1[9:20, 2] = sy[9:, 0], sx[9:20, 2]
    agree = lambda a, b: int((a == b).sum())
    assert agree(sx, sy) == 141 >= near_dedup.LINK and agree(c0, sx) == agree(c1, sy) == 82 >= near_dedup.NEAR
    assert max(agree(c0, sy), agree(c1, sx), agree(c0, c1)) < near_dedup.NEAR
    rows = [(i, bytes([k]) * 16, s.tobytes()) for k, (i, s) in enumerate([(first, c0), (second, c1), (x, sx), (y, sy)])]
    edges = near_dedup._clusters(spark.createDataFrame(rows, "rep long, print binary, sketch binary")).select("u", "v").collect()
    tied, grown = {x}, 0
    while len(tied) != grown:
        grown = len(tied)
        tied |= {n for r in edges if {r["u"], r["v"]} & tied for n in (r["u"], r["v"])}
    assert y in tied
