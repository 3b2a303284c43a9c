import os
import random

import numpy as np
import pytest

from pressloom.llm import packing as P


def optimum(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        seen = set()
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity and bins[b] not in seen:
                seen.add(bins[b])
                bins[b] += sizes[k]
                go(k + 1, bins)
                bins[b] -= sizes[k]
        bins.append(sizes[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def histogram(sizes, capacity):
    return np.bincount(sizes, minlength=capacity + 1)


def test_reduction_keeps_an_optimal_solution():
    rng = random.Random(10)
    for _ in range(150):
        c = rng.randrange(8, 30)
        sizes = [rng.randrange(1, c + 1) for _ in range(rng.randrange(1, 10))]
        rest = P._Sizes(histogram(sizes, c))
        fixed = P.reduce_instance(rest, c)
        left = [s for s in range(1, c + 1) for _ in range(int(rest.count[s]))]
        assert sum(m for _, m in fixed) + optimum(left, c) == optimum(sizes, c)


def test_all_items_are_packed_within_capacity():
    rng = random.Random(11)
    for _ in range(40):
        c = rng.randrange(5, 60)
        sizes = [rng.randrange(1, c + 1) for _ in range(rng.randrange(0, 400))]
        plan = P.solve(histogram(sizes, c), c)
        packed = sorted(s for items, m in plan.groups for s in items for _ in range(m))
        assert packed == sorted(sizes)
        assert all(sum(items) <= c for items, _ in plan.groups)


def test_close_to_the_bound_on_plain_sizes():
    rng = random.Random(12)
    sizes = [rng.randrange(1, 900) for _ in range(5000)]
    plan = P.solve(histogram(sizes, 2048), 2048)
    assert plan.containers <= -(-sum(sizes) // 2048) * 1.01 + 1


def test_containers_of_documents(spark):
    rng = random.Random(13)
    rows = [(k, rng.choice([0, 1, 7, 7, 7, 30, 64, 99, 100, 101, 350])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").repartition(5)
    got = P.pack(spark, df, 100).toPandas()
    assert set(got["doc_id"]) == {k for k, _ in rows}
    fills = got.groupby("container")["size"].sum()
    assert fills.max() <= 100
    whole = got.groupby("doc_id").agg(total=("size", "sum"), pieces=("piece", "size"))
    for k, n in rows:
        assert whole.loc[k, "total"] == n
        assert whole.loc[k, "pieces"] == max(1, -(-n // 100))
    assert sorted(fills.index) == list(range(len(fills)))
    again = P.pack(spark, df.repartition(2), 100).toPandas()
    key = ["doc_id", "piece"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert P.fill(P.pack(spark, df, 100), 100).first()["containers"] == len(fills)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    assert P.pack(spark, df, 100).count() == 0


@pytest.mark.skipif(not os.path.exists(os.path.join(P.VOCABULARY_DIR, P.VOCABULARY)), reason="no vocabulary")
def test_token_counts(spark):
    rows = [(1, "Hello world", 1), (1, "Hello world", 1), (2, "", 0), (3, None, 0), (None, "x", 0), (4, "word " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = {r["doc_id"]: r["tokens"] for r in P.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] >= 50_000 and set(got) == {1, 2, 3, 4}
