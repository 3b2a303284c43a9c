"""Work lists: which articles and stories a step still has to look at, always in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
CLOSED = ("closed", "merged")
TITLES = 8


def moment_of(published: str, first_seen: str) -> Column:
    """When an article appeared: its publication, else when it was first seen."""
    return F.coalesce(published, first_seen)


def recent(articles: DataFrame, published: str, first_seen: str, since: Column) -> DataFrame:
    """Articles that appeared at or after ``since``; those without either time are left out."""
    return articles.filter(moment_of(published, first_seen) >= since)


def live_tagged(stories: DataFrame, since: Column) -> DataFrame:
    """Live stories with a target that were seen at or after ``since``."""
    return stories.filter((F.col("status") == "live") & (F.col("last_seen") >= since) & (F.coalesce("target", F.lit("")) != ""))


def open_stories(stories: DataFrame) -> DataFrame:
    """Stories neither closed nor merged; a missing status is open."""
    return stories.filter(~F.coalesce("status", F.lit("")).isin(*CLOSED))


def untagged(stories: DataFrame) -> DataFrame:
    """Open stories without a target."""
    return open_stories(stories).filter(F.coalesce("target", F.lit("")) == "")


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in a list of any length, however often it is listed."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def first_of(rows: DataFrame, order: list[Column | str], limit: int | None = None) -> DataFrame:
    """The list in its order, cut at ``limit`` if one is asked for."""
    ranked = rows.orderBy(*order)
    return ranked if limit is None else ranked.limit(limit)


def top_titles(members: DataFrame, articles: DataFrame, n: int = TITLES) -> DataFrame:
    """``story_id, titles``: of each story the titles of its ``n`` least article ids, in that order.

    Ranks are cut before titles are gathered, so a story of any size yields one short list.
    """
    rows = members.select("story_id", "article_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("story_id").orderBy("article_id"))).filter(F.col("r") <= n)
    named = rows.join(articles.select(F.col("id").alias("article_id"), "title"), "article_id")
    return named.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]).alias("titles"))


def article_stories(articles: DataFrame, members: DataFrame, stories: DataFrame) -> DataFrame:
    """``id, story_id, name, target``: every article, with its story where it has one that is known."""
    joined = articles.select("id").join(members.select(F.col("article_id").alias("id"), "story_id"), "id", "left")
    return joined.join(stories.select("story_id", "name", "target"), "story_id", "left").select("id", "story_id", "name", "target")


def active_outlets(feeds: DataFrame) -> DataFrame:
    """``outlet_id``: outlets with an active feed."""
    return feeds.filter("active").select("outlet_id").distinct()


def next_ids(**tables: DataFrame) -> DataFrame:
    """``table, next_id``: one more than the greatest id of each table, 1 of an empty one."""
    each = [t.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("next_id")).select(F.lit(n).alias("table"), "next_id") for n, t in tables.items()]
    return reduce(DataFrame.union, each)


def replaced(scores: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``scores`` without the rows whose keys (null is a value) are scored anew, and the new ones.

    Of new rows with equal keys the least counts. Columns are those of ``scores``.
    """
    rest = [c for c in scores.columns if c not in keys]
    fresh = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    gone = fresh.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return scores.join(gone, same, "left_anti").select(*keys, *rest).unionByName(fresh)
