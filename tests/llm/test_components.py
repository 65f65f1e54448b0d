"""Components of small graphs in a few jobs, of larger ones by steps."""

import random

import pytest

from tidemark.llm import components, shared


def _graph(rng):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    rng.shuffle(edges)
    sets = components.Union(3000)
    for a, b in edges:
        sets.join(a, b)
    return edges, {x: sets.root(x) for x in range(3000) if sets.root(x) != x}


def _found(df):
    rows = components.components(df).collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return {r["node"]: r["root"] for r in rows}


def test_a_small_graph_takes_no_steps(spark, docs, monkeypatch):
    made, plain = [], shared.staged
    monkeypatch.setattr(shared, "staged", lambda df, name: made.append(name) or plain(df, name))
    edges, want = _graph(random.Random(8))
    assert _found(spark.createDataFrame(edges, "u long, v long").repartition(6)) == want
    assert len(made) == 2


@pytest.mark.parametrize("most", [0, 40, 400])
def test_a_larger_graph_takes_steps(spark, docs, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    edges, want = _graph(random.Random(9))
    # Edges told twice, the other way round and by many tasks, and loops.
    edges += [(b, a) for a, b in edges[:100]] + edges[100:200] + [(5000, 5000)]
    assert _found(spark.createDataFrame(edges, "u long, v long").repartition(16)) == want
