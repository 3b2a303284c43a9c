"""Cross-outlet copy: equal addresses, equal titles, similar titles; groups and their rate.

Similar titles meet through an inverted index on each title's three rarest tokens. A token on more
than ``POSTINGS`` titles is not rare and makes no pairs (part of the measure's definition), which
also bounds every group that is paired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.operators.components import connected_components
from pressloom.session import cut

# fixed values
THRESHOLD, LEAST_TOKENS, RAREST, POSTINGS = 0.72, 4, 3, 400


def _prepared(articles: DataFrame) -> DataFrame:
    one = articles.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("outlet_id", "url_canon", "title")).alias("r"))
    return one.select("id", "r.*").withColumn("toks", F.array_distinct(T.title_tokens(F.col("title"))))


def same_key_groups(articles: DataFrame) -> DataFrame:
    """``kind, key, first_id, n, outlets``: addresses ('url') and titles ('title') of two or more outlets.

    Empty addresses are no key; titles without tokens share one. Repeated ids count once.
    """
    p = _prepared(articles)
    url = p.filter(F.coalesce("url_canon", F.lit("")) != "").select("id", "outlet_id", F.lit("url").alias("kind"), F.col("url_canon").alias("key"))
    title = p.select("id", "outlet_id", F.lit("title").alias("kind"), T.title_signature(F.col("title")).alias("key"))
    g = url.union(title).groupBy("kind", "key").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.countDistinct("outlet_id").alias("outlets"))
    return g.filter("n > 1 and outlets > 1")


def same_key_edges(articles: DataFrame) -> DataFrame:
    """``id, first_id, kind``: every member of such a group with its first."""
    p = _prepared(articles)
    url = p.filter(F.coalesce("url_canon", F.lit("")) != "").select("id", F.lit("url").alias("kind"), F.col("url_canon").alias("key"))
    title = p.select("id", F.lit("title").alias("kind"), T.title_signature(F.col("title")).alias("key"))
    return url.union(title).join(same_key_groups(articles).select("kind", "key", "first_id"), ["kind", "key"]).select("id", "first_id", "kind")


def similar_title_pairs(articles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b`` (a < b) of different outlets with Jaccard >= threshold that share a rare token.

    Ties among equally rare tokens go to the lesser token.
    """
    p = _prepared(articles).filter(F.size("toks") > 0).select("id", "outlet_id", "toks")
    each = p.select("id", F.explode("toks").alias("t"), F.size("toks").alias("n"))
    df = each.groupBy("t").agg(F.count("*").alias("df"))
    ranked = each.filter(F.col("n") >= LEAST_TOKENS).join(df, "t").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))).filter(F.col("r") <= RAREST)
    posts = ranked.groupBy("t").agg(F.count("*").alias("c")).filter(F.col("c").between(2, POSTINGS))
    index = ranked.select("id", "t").join(posts.select("t"), "t")
    pairs = index.select("t", F.col("id").alias("a")).join(index.select("t", F.col("id").alias("b")), "t").filter("a < b").select("a", "b").distinct()
    x = p.select(F.col("id").alias("a"), F.col("outlet_id").alias("oa"), F.col("toks").alias("ta"))
    y = p.select(F.col("id").alias("b"), F.col("outlet_id").alias("ob"), F.col("toks").alias("tb"))
    both = pairs.join(x, "a").join(y, "b").filter(~F.col("oa").eqNullSafe(F.col("ob")))
    return both.filter(T.jaccard(F.col("ta"), F.col("tb")) >= threshold).select("a", "b")


def copy_groups(articles: DataFrame) -> DataFrame:
    """``id, group_id, method``: group is the least id of all linked; method how an article was matched
    first (url before title before jaccard), null where it was not."""
    # links are read three times below: made once
    same = cut(same_key_edges(articles), "same")
    near = cut(similar_title_pairs(articles), "near")
    labels = connected_components(same.select("id", "first_id").union(near))
    rank = F.create_map(F.lit("url"), F.lit(1), F.lit("title"), F.lit(2), F.lit("jaccard"), F.lit(3))
    ways = same.select("id", "kind").union(near.select(F.col("a").alias("id"), F.lit("jaccard"))).union(near.select(F.col("b").alias("id"), F.lit("jaccard")))
    ways = ways.groupBy("id").agg(F.min_by("kind", rank[F.col("kind")]).alias("method"))
    ids = articles.select("id").filter("id is not null").distinct()
    out = ids.join(labels.select(F.col("node").alias("id"), "root"), "id", "left").join(ways, "id", "left")
    return out.select("id", F.coalesce("root", "id").alias("group_id"), "method")


def duplication_rate(groups: DataFrame) -> DataFrame:
    """One row ``articles, duplicates, rate``; no articles give a rate of 0."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("articles"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return total.withColumn("rate", F.when(F.col("articles") > 0, F.col("duplicates") / F.col("articles")).otherwise(0.0))


def outlet_report(articles: DataFrame, groups: DataFrame) -> DataFrame:
    """``outlet, articles, duplicated, dup_share`` with a TOTAL row; duplicated = in a group of two or more."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    dup = groups.join(sizes, "group_id").select("id", (F.col("n") > 1).alias("dup"))
    one = articles.filter("id is not null").groupBy("id").agg(F.min("outlet_id").alias("outlet_id")).join(dup, "id")
    g = one.rollup("outlet_id").agg(F.grouping("outlet_id").alias("g"), F.count("*").alias("articles"), F.count_if("dup").alias("duplicated"))
    return g.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("outlet_id")).alias("outlet"), "articles", "duplicated", (F.col("duplicated") / F.col("articles")).alias("dup_share"))
