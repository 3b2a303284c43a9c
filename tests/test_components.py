import random

import numpy as np

from pressloom.operators.components import connected_components, min_labels


def brute(edges):
    """Least node reachable from each, by a search of the graph."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for begin in sorted(near):
        todo = [begin] if begin not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = begin
                todo += near[x]
    return out


def test_min_labels_matches_a_search():
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    nodes, roots = min_labels(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == brute(edges)


def test_both_ways_of_finishing_agree(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(5000, 5000 + i) for i in range(1, 50)]  # a hub
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    want = {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    for bound in (10**6, 0):
        got = {r["node"]: r["root"] for r in connected_components(df, single_task_edges=bound).collect()}
        assert got == want


def test_nulls_loops_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3), (4, 5), (4, 5)], "a long, b long")
    assert {tuple(r) for r in connected_components(df).collect()} == {(4, 4), (5, 4)}
    assert connected_components(df.limit(0)).count() == 0
