import brute

from tidemark.llm import exact_dedup, near_dedup


def test_exact_groups(corpus, docs, nothing):
    want = brute.exact(corpus)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.groups(docs).collect()}
    assert got == want
    assert exact_dedup.groups(nothing).count() == 0


def test_exact_keeps_columns_and_nulls(corpus, docs, nothing):
    want = {i for i, (_, _, kept) in brute.exact(corpus).items() if kept}
    rows = exact_dedup.deduplicated(docs).collect()
    texts = dict(corpus)
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
    assert all(r["text"] == texts[r["doc_id"]] and r["keep_id"] == "x" and r["start"] == r["doc_id"] % 3 for r in rows)
    assert exact_dedup.deduplicated(nothing).columns == docs.columns


def test_exact_repeated_rows_and_null_ids(spark, docs):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (2, "c"), (None, None), (None, "")], "doc_id long, text string").repartition(4)
    got = sorted(((r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.groups(rows).collect()), key=str)
    assert sum(k for _, _, k in got) == 3 and sorted(n for _, n, _ in got) == [1, 2, 2, 3, 3, 3]
    assert exact_dedup.deduplicated(rows).count() == 3


def test_one_group_over_many_partitions(spark, docs):
    rows = spark.range(4_000).selectExpr("id AS doc_id", "IF(id % 4 = 0, concat('t', id), 'the  same') AS text")
    got = exact_dedup.groups(rows).where("group_size > 1")
    assert got.count() == 3_000 and got.where("kept").collect()[0]["doc_id"] == 1
    assert {r["keep_id"] for r in got.select("keep_id").distinct().collect()} == {1}


def test_near_links_match_all_pairs(corpus, docs, nothing):
    want = brute.near(corpus)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.link(docs, percent=85).collect()}
    assert got == want
    assert near_dedup.link(nothing, percent=85).count() == 0
    stay = {r["doc_id"] for r in near_dedup.representatives(docs, percent=85).collect()}
    assert stay == {i for i, (_, c) in want.items() if i == c}


def test_many_unlike_rows_in_one_bucket(spark, docs, monkeypatch):
    """Rounds and cells of crowded buckets lose no link."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = [f"w{i // 3}_{k}" for k in range(30)]
        if i % 3:
            own[rng.randrange(30)] = f"x{i}"
        rows.append((i, " ".join(shared + own)))
    want = brute.near(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == want


def test_components_of_long_chains_and_stars(spark, docs):
    import random

    from tidemark.llm import components

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    rng.shuffle(edges)
    sets = components.Union(3000)
    for a, b in edges:
        sets.join(a, b)
    want = {x: sets.root(x) for x in range(3000) if sets.root(x) != x}
    df = spark.createDataFrame(edges, "u long, v long").repartition(6)
    assert {r["node"]: r["root"] for r in components.components(df).collect()} == want
    assert components.components(df.where("u < 0")).count() == 0
