"""Cosine similarity of two sets of vectors, as matrix products over blocks.

The right side is the smaller one (centroids, a stated query set, a day's stories). If its counted
size is within ``SENT_BYTES`` it goes to every task and the left side is not moved. Beyond that both
sides are cut into blocks and each pair of blocks meets in one task, so no side is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut

#: Greatest right side that is sent to every task: numbers x 8 bytes.
SENT_BYTES = 64 << 20
LEFT_BLOCK, RIGHT_BLOCK = 65_536, 8_192
STRIP = 2_048


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return unit(np.vstack(vectors.to_numpy()).astype(np.float64))


def _by_length(ids: np.ndarray, vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    size = vectors.map(len).to_numpy()
    return {int(n): (ids[size == n], _matrix(vectors[size == n])) for n in np.unique(size) if n}


def _met(left: dict, right: dict, threshold: float | None) -> Iterator[pd.DataFrame]:
    """Pairs at or above the threshold; without one, each left row's nearest right row (ties to the lesser id)."""
    for n, (li, lv) in left.items():
        if n not in right:
            continue
        ri, rv = right[n]
        order = np.argsort(ri, kind="stable")
        ri, rv = ri[order], rv[order]
        for s in range(0, len(li), STRIP):
            sims = lv[s : s + STRIP] @ rv.T
            if threshold is None:
                j = sims.argmax(axis=1)
                i = np.arange(len(sims))
            else:
                i, j = np.nonzero(sims >= threshold)
            yield pd.DataFrame({"left": li[i + s], "right": ri[j], "similarity": sims[i, j]})


def _meet(left: DataFrame, right: DataFrame, threshold: float | None) -> DataFrame:
    """``left`` and ``right``: (id long, v array<double>); null vectors are left out."""
    schema = "left long, right long, similarity double"
    left, right = left.filter("v is not null"), cut(right.filter("v is not null"), "right")
    n, width = right.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()  # type: ignore[misc]
    if n * width * 8 <= SENT_BYTES:
        rows = right.toPandas()  # its size is checked above
        shared = left.sparkSession.sparkContext.broadcast(_by_length(rows["id"].to_numpy(), rows["v"]) if len(rows) else {})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield from _met(_by_length(pdf["id"].to_numpy(), pdf["v"]), shared.value, threshold)

        return left.mapInPandas(run, schema)
    left = cut(left, "left")
    a, b = max(1, -(-left.count() // LEFT_BLOCK)), max(1, -(-n // RIGHT_BLOCK))
    ls = left.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(a))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    rs = right.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a - 1).cast("long"))))

    def both(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        parts = list(_met(_by_length(x["id"].to_numpy(), x["v"]), _by_length(y["id"].to_numpy(), y["v"]), threshold)) if len(x) and len(y) else []
        return pd.concat(parts) if parts else pd.DataFrame({"left": np.empty(0, np.int64), "right": np.empty(0, np.int64), "similarity": np.empty(0)})

    return ls.groupBy("i", "j").cogroup(rs.groupBy("i", "j")).applyInPandas(both, schema)


def pairs_at_least(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``left, right, similarity``: all pairs of ``(id, v)`` rows of two sides whose cosine reaches the threshold.

    Vectors of different lengths never meet; zero vectors have similarity 0. Empty sides give no rows.
    """
    return _meet(left, right, threshold)


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left, right, similarity``: for each left row the nearest right row, ties to the lesser id."""
    best = F.max(F.struct("similarity", (-F.col("right")).alias("neg"))).alias("b")
    found = _meet(left, right, None).groupBy("left").agg(best)
    return found.select("left", (-F.col("b.neg")).alias("right"), F.col("b.similarity").alias("similarity"))
