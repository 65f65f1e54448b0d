import brute

import corpus_pipeline
from tidemark.llm import near_dedup


def test_near_stage_matches_all_pairs_at_80(spark, corpus, docs):
    want = brute.near(corpus, 80)
    assert want != brute.near(corpus, 85)
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == {i for i, (_, c) in want.items() if i == c}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.link(docs, percent=80).collect()} == want


def _more(n, p, k):
    """The chance of more than k of n draws."""
    from math import comb

    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))


def test_bounds_hold_at_80():
    bins = near_dedup.BINS
    assert bins % near_dedup.ROWS == 0 and (1 - 0.8**near_dedup.ROWS) ** (bins // near_dedup.ROWS) < 1e-10
    assert _more(bins, 0.2, near_dedup.RING) < 1e-9 and _more(bins, 0.2, bins - near_dedup.LINK) < 1e-9


def test_pairs_at_80_in_crowded_buckets(spark, docs, monkeypatch):
    """Rounds and cells lose no pair of 0.80 up to 0.85."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(11)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = [f"w{i // 3}_{k}" for k in range(30)]
        if i % 3:
            for k in (3, 6) if i % 3 == 1 else (20,):
                own[k] = f"x{i}_{rng.random()}"
        rows.append((i, " ".join(shared + own)))
    want = brute.near(rows, 80)
    assert want != brute.near(rows, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert got == want
