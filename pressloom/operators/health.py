"""Feed monitoring: health flags, last good polls, feed positions and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
STALE_HOURS, FROZEN_HOURS, THIN, HISTORY = 3.0, 24.0, 0.35, 60


def feed_health(polls: DataFrame, now: Column) -> DataFrame:
    """Per feed, over its latest ``HISTORY`` polls: what it usually brings, when it last changed, flags.

    Columns ``feed_id, typical, latest, last_ok, last_changed, fails, looks, not_answering, thin,
    frozen``. Of a feed 60 rows at most are kept before anything is gathered.
    """
    latest = Window.partitionBy("feed_id").orderBy(F.desc("polled_at"), F.desc("id"))
    p = polls.dropDuplicates(["id"]).withColumn("rn", F.row_number().over(latest)).filter(F.col("rn") <= HISTORY)
    p = p.withColumn("ok", F.col("error").isNull() & (F.coalesce("n_items", F.lit(0)) > 0))
    p = p.withColumn("age", (now.cast("double") - F.col("polled_at").cast("double")) / 3600.0)
    ok = Window.partitionBy("feed_id", "ok").orderBy("rn")
    p = p.withColumn("newest", F.first("items_hash").over(ok)).withColumn("same", F.col("items_hash").eqNullSafe(F.col("newest")))
    p = p.withColumn("broken", F.max((~F.col("same")).cast("int")).over(ok.rowsBetween(Window.unboundedPreceding, 0)))
    is_ok = F.col("ok")
    counts = F.array_sort(F.collect_list(F.when(is_ok, F.col("n_items"))))
    g = p.groupBy("feed_id").agg(
        F.when(F.size(counts) > 0, F.element_at(counts, F.floor(F.size(counts) / 2).cast("int") + 1)).alias("typical"),
        F.min_by(F.when(is_ok, F.col("n_items")), F.when(is_ok, F.col("rn"))).alias("latest"),
        F.max(F.when(is_ok, F.col("polled_at"))).alias("last_ok"),
        F.min(F.when(is_ok & (F.col("broken") == 0), F.col("polled_at"))).alias("run_start"),
        F.max(F.when(is_ok & (F.col("broken") == 0), F.col("age"))).alias("run_age"),
        F.count_if(is_ok).alias("n_ok"),
        F.count_if(is_ok & F.col("same")).alias("n_same"),
        (F.coalesce(F.min(F.when(is_ok, F.col("rn"))), F.count("*") + 1) - 1).alias("fails"),
        F.count_if(is_ok & (F.col("age") <= FROZEN_HOURS)).alias("looks"),
        F.max(F.when(is_ok, F.col("age"))).alias("span"),
        F.min(F.when(is_ok, F.col("age"))).alias("h_ok"),
    )
    never = (F.col("n_ok") == F.col("n_same")) & (F.col("n_ok") > 1)
    g = g.withColumn("last_changed", F.when(never, None).otherwise(F.col("run_start")))
    h_new = F.when(~never, F.col("run_age"))
    silent = F.col("h_ok").isNull() | (F.col("h_ok") > STALE_HOURS)
    frozen = (F.col("looks") >= 3) & (F.coalesce("span", F.lit(0.0)) >= FROZEN_HOURS) & (h_new.isNull() | (h_new > FROZEN_HOURS))
    return g.select(
        "feed_id", F.coalesce("typical", F.lit(0)).alias("typical"), F.coalesce("latest", F.lit(0)).alias("latest"), "last_ok", "last_changed", "fails", "looks",
        silent.alias("not_answering"), (~silent & (F.coalesce("typical", F.lit(0)) > 0) & (F.col("latest") < F.col("typical") * THIN)).alias("thin"), frozen.alias("frozen"),
    )


def last_good_poll(feeds: DataFrame, outlets: DataFrame, polls: DataFrame, before: Column) -> DataFrame:
    """Active feeds without a good poll since ``before``: ``feed_id, name, last_good`` (null = never)."""
    good = polls.filter("error is null and n_items > 0").groupBy(F.col("feed_id").alias("_f")).agg(F.max("polled_at").alias("last_good"))
    j = feeds.filter("active").join(outlets.select(F.col("id").alias("outlet_id"), "name"), "outlet_id").join(good, F.col("id") == F.col("_f"), "left")
    return j.filter(F.col("last_good").isNull() | (F.col("last_good") < before)).select(F.col("id").alias("feed_id"), "name", "last_good")


def dense_positions(items: DataFrame, poll: str, article: str, order: list[Column]) -> DataFrame:
    """``poll_id, article_id, position``: places from 0, an article once per poll at its first place."""
    first = items.filter(F.col(article).isNotNull()).groupBy(F.col(poll).alias("poll_id"), F.col(article).alias("article_id")).agg(F.min(F.struct(*order)).alias("o"))
    return first.select("poll_id", "article_id", (F.row_number().over(Window.partitionBy("poll_id").orderBy("o")) - 1).alias("position"))


def best_position(positions: DataFrame) -> DataFrame:
    return positions.groupBy("article_id").agg(F.min("position").alias("best"))


def fingerprints(positions: DataFrame) -> DataFrame:
    """``poll_id, items_hash``: 16 hex digits over a poll's items in order. A poll's items are one feed page."""
    listed = positions.groupBy("poll_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("article_id").cast("string").alias("a")))).alias("l"))
    return listed.select("poll_id", F.substring(F.sha1(F.array_join(F.transform("l", lambda s: s["a"]), "|").cast("binary")), 1, 16).alias("items_hash"))
