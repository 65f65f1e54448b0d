"""The near-dedup stage where ids do not tell rows apart."""

import random

import brute
import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, _td_row string, stays int, `a.b` int"


def _stage(spark, rows, parts):
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(parts)
    found = stage(spark, df, "")
    assert found.columns == df.columns
    return sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_without_an_id_and_of_one_id_are_linked(spark, docs, parts):
    one, two = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    # A null id beside its near duplicate, two of one id, two without an id; copies; texts without words, which are linked with nothing.
    rows = [(1, one), (1, "zz " + one), (2, two), (None, one + " end"), (None, two), (None, two + " end"), (None, "alone"), (None, "alone"), (3, None), (3, ""), (None, None)]
    found = _stage(spark, rows, parts)
    assert [i for i, t in found if t and t.endswith(" a79")] == [1] and not any(t and t.endswith(" end") for _, t in found)
    assert [r for r in found if r[1] == two] == [(2, two)] and [r for r in found if r[1] == "alone"] == [(None, "alone")]
    assert sum(not t for _, t in found) == 3 and len(found) == 6


def test_groups_over_odd_ids_match_all_pairs(spark, docs):
    rng = random.Random(41)
    rows = []
    for g in range(40):
        base = [f"g{g}_{k}" for k in range(rng.choice([3, 8, 60, 120]))]
        for j in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"e{g}_{j}_{rng.random()}"
            rows.append((rng.choice([None, rng.randrange(30)]), " ".join(words)))
    groups = {}
    for k, (_, c) in brute.near(list(enumerate(t for _, t in rows)), 80).items():
        groups.setdefault(c, []).append(rows[k])
    found = _stage(spark, rows, 4)
    assert len(found) == len(groups) < len(rows)
    for members in groups.values():
        least = min(members, key=lambda r: (r[0] is None, r[0] or 0))[0]
        assert sum(r in members and r[0] == least for r in found) == 1
    assert found == _stage(spark, rows, 1)
