"""Previous and next row of a long sequence without one task per sequence.

A plain ``lag`` over (partition by key) puts a hot key into one task. Here the window runs over
(key, block); only one edge row per block crosses blocks, by a second, far smaller window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shift(df: DataFrame, keys: list[str], block: str, order: list[Column], value: Column, out: str, ahead: bool) -> DataFrame:
    inner = Window.partitionBy(*keys, block).orderBy(*order)
    has, step = f"_{out}_has", F.lead if ahead else F.lag
    boxed = F.struct(value.alias("v"))
    df = df.withColumn("_box", boxed)
    edge_rows = (
        df.groupBy(*keys, block)
        .agg((F.min_by if ahead else F.max_by)("_box", F.struct(*order)).alias("_edge"))
        .withColumn("_edge", step("_edge").over(Window.partitionBy(*keys).orderBy(block)))
        .select(*[F.col(k).alias(f"_e_{i}") for i, k in enumerate(keys)], F.col(block).alias("_e_block"), "_edge")
    )
    near = df.withColumn(has, step("_box").over(inner))
    same = [F.col(k).eqNullSafe(F.col(f"_e_{i}")) for i, k in enumerate(keys)] + [F.col(block).eqNullSafe(F.col("_e_block"))]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = near.join(edge_rows, cond, "left")
    return joined.withColumn(out, F.coalesce(F.col(has), F.col("_edge"))).drop(has, "_edge", "_box", "_e_block", *[f"_e_{i}" for i in range(len(keys))])


def previous(df: DataFrame, keys: list[str], block: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds struct ``out`` with field ``v`` of the row before; null on the first row of a key.

    ``block`` must not decrease along ``order`` within a key.
    """
    return _shift(df, keys, block, order, value, out, ahead=False)


def following(df: DataFrame, keys: list[str], block: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds struct ``out`` with field ``v`` of the row after; null on the last row of a key."""
    return _shift(df, keys, block, order, value, out, ahead=True)
