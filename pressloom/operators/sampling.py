"""Draws, packs and tiers. Draws are ordered by a hash of the id, so they repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(*parts: Column, seed: int = 1) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def stratified(items: DataFrame, rid: str, outlet: str, issue: str, n: int = 300, least: int = 20, seed: int = 1) -> DataFrame:
    """Equal share per outlet, within it round-robin over issues, the largest issue first.

    The share is max(least, n // outlets); ties of issues go to the lesser name. A row's place in its
    issue is its hash order. Repeated ids count once.
    """
    one = items.filter(F.col(rid).isNotNull()).select(F.col(rid).alias("id"), F.col(outlet).alias("outlet_id"), F.coalesce(F.col(issue), F.lit("_none")).alias("issue_id")).distinct()
    share = one.agg(F.greatest(F.lit(least), F.floor(F.lit(n) / F.greatest(F.countDistinct("outlet_id"), F.lit(1)))).cast("long").alias("share"))
    sizes = one.groupBy("outlet_id", "issue_id").agg(F.count("*").alias("c"))
    order = sizes.withColumn("turn", F.row_number().over(Window.partitionBy("outlet_id").orderBy(F.desc("c"), "issue_id"))).drop("c")
    inner = Window.partitionBy("outlet_id", "issue_id").orderBy(draw_order(F.col("id"), seed=seed), "id")
    ranked = one.withColumn("rn", F.row_number().over(inner)).join(F.broadcast(share), F.col("rn") <= F.col("share"))  # one row
    ranked = ranked.join(order, ["outlet_id", "issue_id"])
    place = F.row_number().over(Window.partitionBy("outlet_id").orderBy("rn", "turn"))
    return ranked.withColumn("place", place).filter("place <= share").select("id", "outlet_id", "issue_id")


def coverage(sample: DataFrame, thin: int = 20) -> DataFrame:
    """``kind, name, n, too_thin``: what a sample holds, per outlet and per issue."""
    parts = [sample.groupBy(F.lit(k).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n")) for k, c in (("outlet", "outlet_id"), ("issue", "issue_id"))]
    return parts[0].union(parts[1]).withColumn("too_thin", (F.col("kind") == "outlet") & (F.col("n") < thin))


def whole_groups(items: DataFrame, rid: str, group: str, n: int, seed: int = 1) -> DataFrame:
    """All rows of groups drawn in hash order until at least ``n`` rows are reached.

    The running total is over one row per group, by a window per hash prefix and one over prefixes.
    """
    sizes = items.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("c")).withColumn("h", draw_order(F.col("g"), seed=seed))
    sizes = sizes.withColumn("p", F.substring("h", 1, 2))
    per = sizes.groupBy("p").agg(F.sum("c").alias("s"))
    base = per.withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 256 rows
    inside = F.coalesce(F.sum("c").over(Window.partitionBy("p").orderBy("h", "g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = sizes.join(base.select("p", "base"), "p").withColumn("before", F.col("base") + inside).filter(F.col("before") < n)
    return items.join(chosen.select(F.col("g").alias("_chosen")), F.col(group) == F.col("_chosen"), "left_semi").select(F.col(rid).alias("id"), F.col(group).alias("group_id"))


def fixed_packs(items: DataFrame, group: str, order: list[Column], size: int = 20) -> DataFrame:
    """Adds ``pack``: consecutive items of a group in packs of ``size``, numbered from 0."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return items.withColumn("pack", F.floor(rank / size).cast("int"))


def gap_tiers(values: DataFrame, value: str, most: int = 6, least_ratio: float = 1.08) -> DataFrame:
    """``value, tier``: distinct values cut at the ``most - 1`` largest ratios above ``least_ratio``.

    For font sizes and the like: the distinct values, a handful, are put in order in one task.
    """
    v = values.select(F.col(value).alias("value")).filter("value is not null").distinct()
    w = Window.orderBy("value")
    ratio = v.withColumn("ratio", F.col("value") / F.lag("value").over(w)).withColumn("at", F.row_number().over(w))
    cut = F.row_number().over(Window.orderBy(F.desc_nulls_last("ratio"), F.desc("at"))) < most
    marked = ratio.withColumn("cut", (cut & (F.coalesce("ratio", F.lit(0.0)) > least_ratio)).cast("int"))
    return marked.select("value", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("tier"))
