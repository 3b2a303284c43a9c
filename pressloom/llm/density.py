"""Grouping records into similarity clusters (problem 3).

Method: density peaks over blocked neighbour joins.

1. Broken vectors are set aside, the rest scaled to length one; identical vectors of a model are one
   point with a weight.
2. Each model gets pivots, a bounded sample of its own points (about ``PIVOTS`` times the square root
   of the number of points), the hottest for sure and no two equal. Every point joins the blocks of
   its ``BLOCKS`` nearest pivots. Pivots follow the data, so a hot cluster has as many blocks as it
   deserves; blocks beyond ``TILE`` points are cut into tiles that meet pairwise in separate tasks.
3. In a block matrix products, strip by strip, give all similarities. A point's local density is the
   weight of its neighbours in its home block, that of its nearest pivot: one number per point, counted
   once, by which all blocks order their points.
4. In each block a point's pointer goes to its nearest denser neighbour (ties by id). The nearest over
   all blocks is its distance to a denser record; a point without one within the threshold is a peak.
   Groups are asked for as chains of neighbours, so peaks whose points touch are one group.
5. Pointers and peak links are followed to labels by connected components.
6. :func:`describe` tells of a cluster its size, its peaks of greatest density times distance, and its
   most typical members; for these all pairs of the cluster are compared (:func:`with_density`).

Vectors travel as 16-bit integers; pairs within ``MARGIN`` of the threshold are decided again on the
stored vectors. Recall of the blocks is measured against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.operators.components import connected_components, min_labels
from pressloom.session import cut

THRESHOLD = 0.80
BLOCKS = 8
PIVOTS = 0.75
LEAST_PIVOTS, SAMPLE = 8, 65_536
TILE = 16_384
MARGIN = 2e-4
#: Single precision errs by less; points whose clusters are counted in one task.
EXACT, BUCKET = 1e-5, 4096
STRIP = 1024
#: Links of a block kept as a list.
FEW_LINKS = 6_000_000
SCALE = 32767.0


def usable(vectors: DataFrame, rid: str, vector: str, model: str, lengths: dict[str, int], stored: bool = False) -> DataFrame:
    """``id, model, q``: vectors that count, scaled to length one and to 16-bit integers.

    With ``stored`` also ``x``, the numbers as they are stored (see :func:`_stored_type`).

    A vector counts if it and its model are present, it has its model's length, all numbers are
    finite and not all zero. Repeated ids count once (the least row), null ids do not, nor do models
    without a known length.
    """
    wanted = dict(lengths)
    kind = _stored_type(vectors, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("model", pa.string()), ("q", pa.binary()), *([("x", pa.binary())] if stored else [])])

        def blobs(rows: np.ndarray) -> pa.Array:
            size = rows.shape[1] * rows.itemsize
            return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(rows.tobytes())])

        for batch in batches:
            ids, names, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2)
            names = np.array(names, dtype=object)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # missing numbers are NaN
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=0).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for name, n in wanted.items():
                rows = np.flatnonzero((names == name) & (sizes == n))
                if not len(rows):
                    continue
                v = flat[begin[rows][:, None] + np.arange(n)[None, :]]
                good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
                v, rows = v[good], rows[good]
                x = [blobs(v.astype(kind))] if stored else []
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                q = np.rint(v * SCALE).astype("<i2")
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows].astype(np.int64)), pa.array([name] * len(rows)), blobs(q), *x], schema=schema)

    rows = vectors.filter(F.col(rid).isNotNull() & F.col(vector).isNotNull() & F.col(model).isNotNull())
    rows = rows.select(F.col(rid).cast("long").alias("id"), F.col(model).alias("model"), F.col(vector).alias("v"))
    names = ["model", "q", *(["x"] if stored else [])]
    unit = rows.mapInArrow(run, "id long, model string, q binary" + (", x binary" if stored else ""))
    return unit.groupBy("id").agg(F.min(F.struct(*names)).alias("r")).select("id", *[f"r.{c}" for c in names])


def _stored_type(vectors: DataFrame, vector: str) -> str:
    """The numpy type that holds the column's numbers without loss."""
    return "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"


def points_of(unit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points ``rep, model, q, weight``; membership ``id, rep``): equal vectors are one point."""
    key = [F.xxhash64("model", "q").alias("k"), F.hash("q", "model").alias("h")]
    reps = unit.groupBy(*key).agg(F.min(F.struct("id", "model", "q")).alias("r"), F.count("*").cast("float").alias("weight"))
    points = reps.select("r.model", F.col("r.id").alias("rep"), "r.q", "weight")
    members = unit.select("id", *key).join(reps.select("k", "h", F.col("r.id").alias("rep")), ["k", "h"]).select("id", "rep")
    return points, members


def unpack(blobs: Iterable[bytes], n: int) -> np.ndarray:
    """(n, dimensions) float32 of length one from 16-bit integers."""
    v = np.frombuffer(b"".join(blobs), "<i2").reshape(n, -1).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def choose_pivots(points: DataFrame, counts: dict[str, tuple[int, float]]) -> dict[str, np.ndarray]:
    """Pivots of each model, at most ``SAMPLE`` for one; ``counts`` its points and their weight.

    No two pivots are equal, else a hot point's neighbours would spread over its equal blocks. Points
    that hold more than a pivot's share of the rows are pivots, the others those of least hash.
    """
    out = {}
    for model, (n, rows) in counts.items():
        want = int(min(max(LEAST_PIVOTS, PIVOTS * np.sqrt(n)), SAMPLE))
        hot = F.col("weight") * want > rows  # fewer than ``want`` points
        found = points.filter(F.col("model") == model).orderBy(F.desc(hot), F.xxhash64("rep"), "rep").select("q").limit(want).collect()
        out[model] = unpack((bytes(r["q"]) for r in found), len(found))
    return out


def _assign(pivots, offsets: dict[str, int], blocks: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pivots.value
        for pdf in batches:
            for model, part in pdf.groupby("model", sort=False):
                p = table[model]
                m = min(blocks, len(p))
                for s in range(0, len(part), 2048):
                    sub = part.iloc[s : s + 2048]
                    blobs = sub["q"].to_numpy()
                    sims = unpack(blobs, len(sub)) @ p.T
                    near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                    home = np.take_along_axis(sims, near, axis=1).argmax(axis=1)[:, None] == np.arange(m)[None, :]
                    yield pd.DataFrame(
                        {
                            "block": (near + offsets[model]).ravel(),
                            "rep": np.repeat(sub["rep"].to_numpy(), m),
                            "weight": np.repeat(sub["weight"].to_numpy(np.float32), m),
                            "q": np.repeat(blobs, m),
                            "home": home.ravel(),
                        }
                    )

    return run


class _Links:
    """Neighbours in one block: as a list if they are few, otherwise computed strip by strip again.

    In a dense block (a hot cluster) nearly all pairs are neighbours; there only whole-matrix
    operations are used and no list of pairs is ever made. Two tiles of a block are treated as one set
    of points.
    """

    def __init__(self, v: np.ndarray, threshold: float):
        self.v, self.n = v, len(v)
        self.lo, self.hi = np.float32(threshold - MARGIN), np.float32(threshold + MARGIN)
        self.few: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _strips(self) -> Iterator[tuple[int, np.ndarray]]:
        for s in range(0, self.n, STRIP):
            sims = self.v[s : s + STRIP] @ self.v.T
            sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2.0
            yield s, sims

    def first_pass(self) -> tuple[np.ndarray, np.ndarray]:
        """Finds the neighbours; returns the pairs too near the threshold to tell."""
        kept: list | None = []
        total, da, db = 0, [], []
        for s, sims in self._strips():
            near = sims >= self.hi
            i, j = np.nonzero((sims >= self.lo) & ~near)
            half = i + s < j
            da.append(i[half] + s)
            db.append(j[half])
            total += int(np.count_nonzero(near))
            if kept is not None and total > FEW_LINKS:
                kept = None
            if kept is not None:
                i, j = np.nonzero(near)
                kept.append(((i + s).astype(np.int32), j.astype(np.int32), sims[i, j]))
        if kept:
            self.few = tuple(np.concatenate(x) for x in zip(*kept, strict=True))  # type: ignore[assignment]
        return np.concatenate(da) if da else np.empty(0, int), np.concatenate(db) if db else np.empty(0, int)

    def pointers(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's nearest denser neighbour (of equally near ones the densest), else itself; and how near."""
        pointer, nearness = np.arange(self.n), np.full(self.n, -2.0, np.float32)
        if self.few is not None:
            i, j, value = self.few
            up = rank[j] < rank[i]
            i, j, value = i[up], j[up], value[up]
            by = np.lexsort((rank[j], -value, i))
            i, j, value = i[by], j[by], value[by]
            lead = np.ones(len(i), bool)
            lead[1:] = i[1:] != i[:-1]
            pointer[i[lead]], nearness[i[lead]] = j[lead], value[lead]
            return pointer, nearness
        order = np.argsort(rank)  # columns by density: the first greatest is the densest
        for s, sims in self._strips():
            sims = sims[:, order]
            sims[(sims < self.hi) | (np.arange(self.n)[None, :] >= rank[s : s + STRIP, None])] = -2.0
            best = sims.argmax(axis=1)
            value = sims[np.arange(len(sims)), best]
            has = value > -2.0
            pointer[s : s + STRIP][has], nearness[s : s + STRIP][has] = order[best[has]], value[has]
        return pointer, nearness

    def touching(self, peak: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Peaks whose points are neighbours, each with the least peak it is so chained to."""
        a = b = np.empty(0, np.int64)

        def chain(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            apart = x != y
            if not apart.any() and not len(a):
                return a, b
            code = np.unique(x[apart].astype(np.int64) * self.n + y[apart])
            nodes, roots = min_labels(np.concatenate([a, code // self.n]), np.concatenate([b, code % self.n]))
            keep = nodes != roots
            return nodes[keep], roots[keep]

        if self.few is not None:
            i, j, _ = self.few
            return chain(peak[i], peak[j])
        for s, sims in self._strips():
            i, j = np.nonzero((sims >= self.hi) & (peak[s : s + STRIP, None] != peak[None, :]))
            a, b = chain(peak[i + s], peak[j])
        return a, b


def _home_density(threshold: float):  # noqa: ANN202
    """Of one block (or pair of tiles) the weight of the neighbours of the points that are at home in it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, weight, home = unpack(pdf["q"].to_numpy(), len(pdf)), pdf["weight"].to_numpy(np.float64), pdf["home"].to_numpy(bool)
        tile, total = pdf["tile"].to_numpy(), np.zeros(len(pdf))
        sides = {(int(pdf["first"].iloc[0]), int(pdf["second"].iloc[0]))}
        sides |= {(b, a) for a, b in sides}
        for mine, other in sides:
            at, across = np.flatnonzero(home & (tile == mine)), np.flatnonzero(tile == other)
            columns = v[across].T
            for s in range(0, len(at), STRIP):
                near = (v[at[s : s + STRIP]] @ columns) >= threshold
                total[at[s : s + STRIP]] += near.astype(np.float64) @ weight[across]
        return pd.DataFrame({c: pdf[c].to_numpy() for c in ("block", "first", "second", "rep")} | {"w": total})

    return run


def _block_links(threshold: float, tell: bool):  # noqa: ANN202
    """All links of one block (or pair of tiles) as pointers and doubtful pairs.

    Rows out: kind 0 link (a, b), along pointers or between peaks whose points touch; 2 pair too near
    the threshold; 1, if ``tell``, pointer of a to its nearest denser neighbour b here, with similarity s.
    """

    def run(pdf: pd.DataFrame, densities: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        rep = pdf["rep"].to_numpy(np.int64)
        density = densities.sort_values("rep", kind="stable")["density"].to_numpy(np.float64)
        n = len(rep)
        links = _Links(unpack(pdf["q"].to_numpy(), n), threshold)
        da, db = links.first_pass()
        order = np.lexsort((rep, -density))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        pointer, nearness = links.pointers(rank)
        peak = pointer
        while not np.array_equal(peak[peak], peak):
            peak = peak[peak]
        ta, tb = links.touching(peak)
        below = np.flatnonzero(pointer != np.arange(n))
        told = below if tell else below[:0]
        sizes = (len(below) + len(ta), len(told), len(da))
        near = np.zeros(sum(sizes), np.float32)
        near[sizes[0] : sizes[0] + sizes[1]] = nearness[told]
        return pd.DataFrame(
            {
                "kind": np.repeat(np.array([0, 1, 2], np.int8), sizes),
                "a": np.concatenate([rep[below], rep[ta], rep[told], rep[da]]),
                "b": np.concatenate([rep[peak[below]], rep[tb], rep[pointer[told]], rep[db]]),
                "s": near,
            }
        )

    return run


def similarity_clusters(vectors: DataFrame, rid: str, vector: str, model: str, lengths: dict[str, int], threshold: float = THRESHOLD, blocks: int = BLOCKS, densities: bool = True) -> DataFrame:
    """``id, cluster_id, density, distance, peak``: clusters of two or more; ``cluster_id`` the least id of a cluster.

    See :func:`usable` for the vectors that count. Points of different models never meet. Equal
    vectors belong together. ``density`` is of :func:`with_density`, ``distance`` that to the nearest denser
    record (1 for a peak, and for all that are equal to it), ``peak`` true once per peak; all three are
    left out if ``densities`` is false. Empty input gives no rows.
    """
    spark = vectors.sparkSession
    unit = cut(usable(vectors, rid, vector, model, lengths), "unit")
    points, members = points_of(unit)
    points = cut(points, "points")
    counts = {r["model"]: (r["n"], r["w"]) for r in points.groupBy("model").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}  # one row per model
    pivots = choose_pivots(points, counts)
    offsets, total = {}, 0
    for name, p in pivots.items():
        offsets[name], total = total, total + len(p)
    shared = spark.sparkContext.broadcast(pivots)  # bounded by SAMPLE pivots of a model
    placed = points.mapInPandas(_assign(shared, offsets, blocks), "block long, rep long, weight float, q binary, home boolean")
    fullest = max((int(np.ceil(n * blocks / TILE)) for n, _ in counts.values()), default=1)
    tiles = _tile(placed, fullest)
    key = ["block", "first", "second"]
    told = tiles.groupBy(*key).applyInPandas(_home_density(threshold), "block long, first int, second int, rep long, w double")
    # a point has at most ``blocks`` rows, times the tiles of its blocks
    density = told.select(*key, "rep", F.sum("w").over(Window.partitionBy("rep")).alias("density"))
    found = tiles.groupBy(*key).cogroup(density.groupBy(*key)).applyInPandas(_block_links(threshold, densities), "kind byte, a long, b long, s float")
    found = cut(found, "links")
    sure = found.filter("kind = 0").select("a", "b")
    decided = _decide(vectors, rid, vector, found.filter("kind = 2").select("a", "b").distinct(), threshold)
    labels = connected_components(sure.union(decided))
    root = members.join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left")
    named = root.select("id", F.coalesce("root", "rep").alias("root"))
    sizes = named.groupBy("root").agg(F.min("id").alias("cluster_id"), F.count("*").alias("n")).filter("n > 1")
    clusters = named.join(sizes, "root").select("id", "cluster_id")
    if not densities:
        return clusters
    # distance to the nearest denser record: the nearest pointer of all blocks; peaks have none within reach
    reach = found.filter("kind = 1").groupBy("a").agg((1 - F.max("s")).cast("double").alias("d"))
    away = members.join(reach, F.col("rep") == F.col("a"), "left").select("id", F.coalesce("d", F.lit(1.0)).alias("distance"), (F.col("d").isNull() & (F.col("id") == F.col("rep"))).alias("peak"))
    return with_density(clusters, vectors, rid, vector, model, lengths, threshold).join(away, "id")


def with_density(clusters: DataFrame, vectors: DataFrame, rid: str, vector: str, model: str, lengths: dict[str, int], threshold: float = THRESHOLD) -> DataFrame:
    """``id, cluster_id, density``: how many of a cluster's vectors are neighbours, the id's own included.

    Neighbours are in one cluster, so every pair of a cluster is compared, on the stored vectors and
    whatever the blocks were: the work is the square of a cluster's distinct vectors.
    """
    clusters = cut(clusters, "clusters")
    unit = usable(vectors, rid, vector, model, lengths, stored=True).join(clusters, "id")
    unit = cut(unit.select("id", F.col("cluster_id").alias("model"), F.col("x").alias("q")), "stored")  # a cluster has one model
    points, members = points_of(unit)
    points = cut(points.withColumnRenamed("model", "cluster_id"), "distinct")
    n = points.count()
    bucket = F.pmod(F.xxhash64("cluster_id"), F.lit(max(1, int(np.ceil(n / BUCKET))))).alias("block")
    # one cluster may hold all points
    tiles = _tile(points.select(bucket, "cluster_id", "rep", "weight", "q"), int(np.ceil(n / TILE)))
    parts = tiles.groupBy("block", "first", "second").applyInPandas(_count_neighbours(threshold, _stored_type(vectors, vector)), "rep long, w double")
    density = parts.groupBy("rep").agg(F.sum("w").alias("density"))
    return members.join(density, "rep").join(clusters, "id").select("id", "cluster_id", "density")


def _count_neighbours(threshold: float, kind: str):  # noqa: ANN202
    """Weight of each point's neighbours, itself included, in its cluster's part of a pair of tiles.

    Similarities within ``EXACT`` of the threshold are computed again in double precision.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cluster_id", "rep"], kind="stable")
        cluster, tile, q = pdf["cluster_id"].to_numpy(), pdf["tile"].to_numpy(), pdf["q"].to_numpy()
        weight, total = pdf["weight"].to_numpy(np.float64), np.zeros(len(pdf))
        first, second = pdf["first"].iloc[0], pdf["second"].iloc[0]
        starts = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
        for s, e in zip(starts, [*starts[1:], len(pdf)], strict=True):
            a = s + np.flatnonzero(tile[s:e] == first)
            b = s + np.flatnonzero(tile[s:e] == second)
            if not len(a) or not len(b):
                continue
            v = np.frombuffer(b"".join(q[s:e]), kind).reshape(e - s, -1).astype(np.float64)
            v /= np.abs(v).max(axis=1, keepdims=True)
            square = np.einsum("ij,ij->i", v, v)
            light = (v / np.sqrt(square)[:, None]).astype(np.float32)
            across = light[b - s].T
            for k in range(0, len(a), STRIP // 2):
                strip = a[k : k + STRIP // 2]
                sims = light[strip - s] @ across
                near = sims >= threshold
                i, j = np.nonzero(np.abs(sims - np.float32(threshold)) < EXACT)
                x, y = strip[i] - s, b[j] - s
                near[i, j] = np.einsum("ij,ij->i", v[x], v[y]) / np.sqrt(square[x] * square[y]) >= threshold
                if first == second:
                    near[np.arange(len(strip)), np.arange(k, k + len(strip))] = True
                near = near.astype(np.float64)
                total[strip] += near @ weight[b]
                if first != second:
                    total[b] += weight[strip] @ near
        return pd.DataFrame({"rep": pdf["rep"].to_numpy(np.int64), "w": total})

    return run


def _decide(vectors: DataFrame, rid: str, vector: str, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose stored vectors, in double precision, reach the threshold."""
    pairs = cut(pairs, "doubtful")
    ends = pairs.select(F.col("a").alias("e")).union(pairs.select(F.col("b").alias("e"))).distinct()
    stored = vectors.select(F.col(rid).cast("long").alias("e"), F.col(vector).alias("v")).join(ends, "e", "left_semi")
    stored = stored.groupBy("e").agg(F.min("v").alias("v")).withColumn("v", F.col("v").cast("array<double>"))
    va, vb = stored.select(F.col("e").alias("a"), F.col("v").alias("va")), stored.select(F.col("e").alias("b"), F.col("v").alias("vb"))

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)

    cosine = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    return pairs.join(va, "a").join(vb, "b").filter(cosine >= threshold).select("a", "b")


def _tile(placed: DataFrame, fullest: int) -> DataFrame:
    """Adds ``tile, first, second``: blocks beyond TILE points are met tile by tile, in pairs."""
    if fullest <= 1:
        return placed.select("*", F.lit(0).alias("tile"), F.lit(0).alias("first"), F.lit(0).alias("second"))
    sizes = placed.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("t")).filter("t > 1")
    cut_up = placed.join(F.broadcast(sizes), "block", "left").withColumn("t", F.coalesce("t", F.lit(1)))
    cut_up = cut_up.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("t")).cast("int"))
    pairs = cut_up.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    return pairs.select(*placed.columns, "tile", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"))


def describe(clusters: DataFrame, typical: int = 3) -> DataFrame:
    """One row per cluster: ``cluster_id, size, peaks, chief, typical``.

    ``peaks``: how many density peaks were chained; ``chief``: the peak of greatest density times distance
    (ties by id); ``typical``: ids of greatest density. The top ids are picked by bounded aggregates,
    never by collecting a cluster.
    """
    ranked = clusters.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("density"), "id"))).filter(F.col("r") <= typical)
    best = ranked.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t"))
    chief = F.max(F.struct((F.col("density") * F.col("distance") * F.col("peak").cast("int")).alias("g"), (-F.col("id")).alias("neg")))
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_if("peak").alias("peaks"), (-chief["neg"]).alias("chief"))
    return sizes.join(best, "cluster_id").select("cluster_id", "size", "peaks", "chief", F.transform("t", lambda x: x["id"]).alias("typical"))
