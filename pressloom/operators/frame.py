"""Stories as shapes: who covers them, where that press stands, and how their stance leans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.text import confidence_weight

# fixed values
EASE, TOP, MIN_OUTLETS = 0.88, 40, 2
RING_INNER, RING_WIDTH = 0.09, 0.83


def story_outlets(rows: DataFrame) -> DataFrame:
    """Article rows (``story_id, outlet_id, stance, confidence``) -> per story and outlet: n, weights.

    First level of two, combined map-side, so a story with a third of all rows is no hot spot.
    """
    w = F.when(F.col("stance").isNotNull(), confidence_weight(F.col("confidence")))
    return rows.groupBy("story_id", "outlet_id").agg(F.count("*").alias("n"), F.count("stance").alias("scored"), F.sum(w).alias("sw"), F.sum(F.col("stance") * w).alias("swx"))


def shapes(per_outlet: DataFrame, outlets: DataFrame, least_outlets: int = MIN_OUTLETS) -> DataFrame:
    """Per story: articles, scored, outlets, angle, stance and its fitted ends on the left-right axis.

    The ends come from a weighted least-squares line of an outlet's mean stance on its leaning, at the
    outermost leanings, eased back to ``EASE``; one outlet gives a point, no score gives nulls.
    """
    o = outlets.select(F.col("id").alias("outlet_id"), "leaning", "market", "weight")
    j = per_outlet.join(F.broadcast(o), "outlet_id", "left")  # outlets: a small dimension that does not grow
    has = F.col("leaning").isNotNull() & (F.col("sw") > 0)
    x, w = F.when(has, F.col("leaning")), F.when(has, F.col("sw"))
    y = F.when(has, F.col("swx") / F.col("sw"))
    g = j.groupBy("story_id").agg(
        F.sum("n").alias("articles"), F.sum("scored").alias("scored"), F.count("*").alias("outlets"),
        F.sum(F.col("leaning") * F.col("weight")).alias("ax"), F.sum(F.col("market") * F.col("weight")).alias("ay"), F.sum(F.when(F.col("leaning").isNotNull(), F.col("weight"))).alias("aw"),
        F.count(y).alias("pts"), F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"),
        F.min(x).alias("lo_x"), F.max(x).alias("hi_x"),
    )
    g = g.filter((F.col("outlets") >= least_outlets) & (F.col("aw") > 0))
    mx, mean = F.col("sx") / F.col("s"), F.col("sy") / F.col("s")
    var, cov = F.col("sxx") - F.col("sx") * mx, F.col("sxy") - F.col("sx") * mean
    slope = F.when(var > 1e-9, cov / var).otherwise(0.0)

    def end(c: str) -> F.Column:
        return F.when(F.col("pts") > 1, mean + slope * (F.col(c) - mx) * EASE).otherwise(mean)

    return g.select(
        "story_id", "articles", "scored", "outlets", F.atan2(F.col("ay") / F.col("aw"), F.col("ax") / F.col("aw")).alias("angle"),
        mean.alias("stance"), end("lo_x").alias("stance_lo"), end("hi_x").alias("stance_hi"),
    )


def top_shapes(all_shapes: DataFrame, n: int = TOP) -> DataFrame:
    """The ``n`` stories with most articles, ties to the lesser id (the feature is a top-n)."""
    return all_shapes.orderBy(F.desc("articles"), "story_id").limit(n)


def rings(top: DataFrame) -> DataFrame:
    """Adds ``ring``: distance from the centre by rank of breadth, broad stories inside. ``top`` is small."""
    w = Window.orderBy(F.desc("outlets"), "story_id")
    place, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy())
    return top.withColumn("ring", RING_INNER + RING_WIDTH * F.when(n > 1, place / (n - 1)).otherwise(0.0))


def spearman(rows: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """One row ``n, rho``: correlation of ranks, ties in order of ``tie``. For small results, as ranks are global."""
    r = rows.select(F.row_number().over(Window.orderBy(x, tie)).alias("rx"), F.row_number().over(Window.orderBy(y, tie)).alias("ry"))
    return r.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("rx", "ry")).alias("rho"))
