"""Queries of the training-data problems (2, 3, 5, 7, 8, 9) over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.llm import density, history, leakage, neardup, packing, queries_sql, sentences
from pressloom.session import table

#: Length of each model's vectors.
LENGTHS = {"sentence": 96, "sentence-2": 96, "hashed": 128}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pairs = neardup.near_duplicates(table(spark, sf_dir, "article"), "id", neardup.word_set("title", "standfirst"))
    return neardup.all_pairs(members, pairs).select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per article: its class and the number of other classes it is linked to."""
    members, pairs = neardup.near_duplicates(table(spark, sf_dir, "article"), "id", neardup.word_set("title", "standfirst"))
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep")))
    links = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(links, "rep", "left").select(F.col("id").alias("article_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _clusters(spark: SparkSession, sf_dir: str, densities: bool) -> DataFrame:
    return density.similarity_clusters(table(spark, sf_dir, "article"), "id", "vector", "vector_model", LENGTHS, densities=densities)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir, False).select(F.col("id").alias("article_id"), "cluster_id")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster: size and its most typical articles."""
    return density.describe(_clusters(spark, sf_dir, True))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "article").select("id", "batch", "outlet_id", "url_canon", "guid")
    batches = sorted({0} | {r["batch"] for r in a.select("batch").filter("batch is not null").distinct().collect()})  # a handful of numbers
    return history.repeats(a, "id", "batch", "outlet_id", "url_canon", "guid", batches)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how well the containers are filled."""
    return packing.fill(p7_containers(spark, sf_dir))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(spark, table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", "lang")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and item: the longest verbatim match, the token at which it starts, and all places of a match."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id", "longest", "at", "places")


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that hold no test item."""
    return leakage.without_leaks(table(spark, sf_dir, "documents").select("doc_id").distinct(), "doc_id", _leaks(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found,
        "p2_classes": p2_classes,
        "p3_found": p3_found,
        "p3_clusters": p3_clusters,
        "p5_found": p5_found,
        "p7_containers": p7_containers,
        "p7_fill": p7_fill,
        "p8_found": p8_found,
        "p8_matches": p8_matches,
        "p8_kept": p8_kept,
        "p9_found": p9_found,
    }


def oracle_sql() -> dict[str, str]:
    return queries_sql.oracle_sql()
