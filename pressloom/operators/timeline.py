"""Day-by-day history: carried presence and stance, bridged gaps, day's biggest, risers, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions.text import confidence_weight

# fixed values
CARRY = (1.0, 0.5, 0.25)
TOP_PER_DAY, HEADLINES, LEAST_RISE = 40, 12, 0.02
CAPTION_ORDER = ("bbc", "sky", "c4", "itv")


def carried(rows: DataFrame, keys: list[str], day: str, last_day: F.Column | None = None) -> DataFrame:
    """``keys, day, vol``: articles per day, counting a half and a quarter on the next two days.

    Three rows per counted day, combined map-side; days after ``last_day`` are cut off.
    """
    daily = rows.groupBy(*keys, F.col(day).alias("day")).agg(F.count("*").alias("n"))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(CARRY)]))
    spread = daily.withColumn("s", steps).select(*keys, F.expr("day + s.k").alias("day"), (F.col("n") * F.col("s.w")).alias("v"))
    if last_day is not None:
        spread = spread.filter(F.col("day") <= last_day)
    return spread.groupBy(*keys, "day").agg(F.sum("v").alias("vol"))


def carried_stance(rows: DataFrame, keys: list[str], day: str, calendar: DataFrame) -> DataFrame:
    """``keys, day, stance``: weighted mean carried like presence; its last value holds on silent days.

    ``calendar``: one column ``day``. Days before a key's first score have no row.
    """
    scored = rows.filter("stance is not null").withColumn("w", confidence_weight(F.col("confidence")))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(CARRY)]))
    spread = scored.withColumn("s", steps).select(*keys, F.expr(f"{day} + s.k").alias("day"), (F.col("stance") * F.col("w") * F.col("s.c")).alias("num"), (F.col("w") * F.col("s.c")).alias("den"))
    means = spread.groupBy(*keys, "day").agg((F.sum("num") / F.sum("den")).alias("mean"))
    spans = means.groupBy(*keys).agg(F.min("day").alias("first"))
    ends = calendar.agg(F.max("day").alias("last"))
    dense = spans.join(F.broadcast(ends), F.lit(True)).select(*keys, F.explode(F.sequence("first", "last")).alias("day"))  # one row
    w = Window.partitionBy(*keys).orderBy("day")
    return dense.join(means, [*keys, "day"], "left").select(*keys, "day", F.last("mean", ignorenulls=True).over(w).alias("stance"))


def bridged(series: DataFrame, keys: list[str], calendar: DataFrame) -> DataFrame:
    """``keys, day, vol``: uncollected days become a straight line between the collected days beside them.

    ``calendar``: ``day, polled``. A gap at the end keeps the last value, one at the start stays as it is.
    Each key gets every day of the calendar; a day without a row is 0.
    """
    ids = series.select(*keys).distinct()
    bounds = calendar.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    dense = ids.join(F.broadcast(bounds), F.lit(True)).select(*keys, F.explode(F.sequence("a", "z")).alias("day"))  # one row
    full = dense.join(series, [*keys, "day"], "left").join(calendar, "day", "left").withColumn("vol", F.coalesce("vol", F.lit(0.0))).withColumn("polled", F.coalesce("polled", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy("day")
    known = F.when(F.col("polled"), F.struct("day", "vol"))
    back = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    full = full.withColumn("b", back).withColumn("f", ahead)
    line = F.col("b.vol") + (F.col("f.vol") - F.col("b.vol")) * F.datediff("day", F.col("b.day")) / F.datediff(F.col("f.day"), F.col("b.day"))
    value = F.when(F.col("polled") | F.col("b").isNull(), F.col("vol")).when(F.col("f").isNotNull(), line).otherwise(F.col("b.vol"))
    return full.select(*keys, "day", value.alias("vol"))


def trimmed(volumes: DataFrame) -> DataFrame:
    """The volumes up to the last day on which any is above zero; without such a day none."""
    last = volumes.filter("vol > 0").agg(F.max("day").alias("_last"))
    return volumes.join(F.broadcast(last), F.col("day") <= F.col("_last")).drop("_last")  # one row


def day_leaders(volumes: DataFrame, n: int = TOP_PER_DAY) -> DataFrame:
    """The ``n`` largest stories of each day, ties to the lesser id."""
    w = Window.partitionBy("day").orderBy(F.desc("vol"), "story_id")
    return volumes.filter("vol > 0").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("day", "story_id", "vol", "place")


def headlines(rows: DataFrame, n: int = HEADLINES) -> DataFrame:
    """Per story and outlet the ``n`` most prominent, latest first, ties to the lesser id."""
    w = Window.partitionBy("story_id", "outlet_id").orderBy(F.desc("prominence"), F.desc("day"), "article_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def risers(volumes: DataFrame, calendar: DataFrame, least: float = LEAST_RISE) -> DataFrame:
    """``day, story_id, rise``: on each collected day after a collected day, the story whose share of the
    day rose most, if by ``least``; ties to the lesser id."""
    total = volumes.groupBy("day").agg(F.sum("vol").alias("tot"))
    share = volumes.join(total, "day").select("story_id", "day", (F.col("vol") / F.when(F.col("tot") == 0, 1.0).otherwise(F.col("tot"))).alias("share"))
    before = share.select("story_id", F.date_add("day", 1).alias("day"), F.col("share").alias("prev"))
    good = calendar.filter("polled").select("day")
    pairs = good.join(good.select(F.date_add("day", 1).alias("day")), "day")
    rise = share.join(before, ["story_id", "day"], "full").join(pairs, "day", "left_semi").select("day", "story_id", (F.coalesce("share", F.lit(0.0)) - F.coalesce("prev", F.lit(0.0))).alias("rise"))
    best = rise.groupBy("day").agg(F.max(F.struct("rise", (-F.col("story_id")).alias("neg"))).alias("b"))
    return best.select("day", (-F.col("b.neg")).alias("story_id"), F.col("b.rise").alias("rise")).filter(F.col("rise") >= least)


def captions(events: DataFrame, heads: DataFrame, names: DataFrame, order: tuple[str, ...] = CAPTION_ORDER) -> DataFrame:
    """Adds ``caption``: that day's headline of the first outlet in ``order``, else of any, else the name."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(o) for o in order]), F.col("outlet_id")), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    pick = heads.withColumn("r", rank).groupBy("story_id", "day").agg(F.min_by("title", F.struct("r", "outlet_id", "place")).alias("t"))
    return events.join(pick, ["story_id", "day"], "left").join(names.select("story_id", "name"), "story_id", "left").select("day", "story_id", "rise", F.coalesce("t", "name").alias("caption"))
