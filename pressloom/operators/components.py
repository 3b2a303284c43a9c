"""Connected components of an edge list, for duplicate groups and clusters.

Edges are first contracted inside each partition (a vectorised union-find over Arrow batches), so
what is shuffled is at most one edge per node and partition. The rest is finished in one bounded
task when its counted size allows, otherwise by alternating large-star and small-star rounds, each
cut to the shared folder. Every aggregation has a map-side half, so a node with a third of all
edges is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut, drop_cut

#: Edges that one task may finish alone: 2 x 8 bytes each, 32 MB.
SINGLE_TASK_EDGES = 2_000_000
EDGE_SCHEMA = "node long, root long"


def min_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component, by hooking and pointer jumping."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = idx[: len(a)], idx[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [(p.iloc[:, 0].to_numpy(np.int64), p.iloc[:, 1].to_numpy(np.int64)) for p in batches if len(p)]
    if not parts:
        return
    nodes, roots = min_labels(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    keep = nodes != roots
    yield pd.DataFrame({"node": nodes[keep], "root": roots[keep]})


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.col("node").alias("u"), F.col("root").alias("v")).union(e.select(F.col("root").alias("u"), F.col("node").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    pairs = _both_ways(e)
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.filter("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = down.join(least, "u").filter("v <> m").select(F.col("v").alias("node"), F.col("m").alias("root"))
    return kept.union(least.select(F.col("u").alias("node"), F.col("m").alias("root"))).distinct()


def connected_components(edges: DataFrame, single_task_edges: int = SINGLE_TASK_EDGES, max_rounds: int = 40) -> DataFrame:
    """``edges`` (two long columns, any names) -> ``node, root`` with root the least node.

    Every node that appears in an edge between two different nodes gets one row, roots included.
    Null ends and self-loops are ignored; repeated edges count once; no edges give no rows.
    """
    a, b = edges.columns[:2]
    clean = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root")).filter("node <> root")
    work = cut(clean.mapInPandas(_contract, EDGE_SCHEMA), "edges")
    if work.count() <= single_task_edges:
        stars = work.coalesce(1).mapInPandas(_contract, EDGE_SCHEMA)
        stars = cut(stars, "stars")
        drop_cut(work)
    else:
        stars, before = work, None
        for _ in range(max_rounds):
            new = cut(_small_star(_large_star(stars)), "stars")
            drop_cut(stars)
            stars = new
            seen = stars.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
            if seen == before:
                break
            before = seen
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
