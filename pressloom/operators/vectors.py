"""Word-counting vectors, rarity, centroids and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.operators import similarity

DIMENSIONS = 512


def document_frequency(docs: DataFrame, did: str, tokens: F.Column) -> DataFrame:
    """``token, df``: documents that hold a token. Repeated rows of an id count once."""
    one = docs.select(F.col(did).alias("d"), F.explode(F.array_distinct(tokens)).alias("token")).distinct()
    return one.groupBy("token").agg(F.count("*").alias("df"))


def rarity(docs: DataFrame, did: str, tokens: F.Column) -> DataFrame:
    """``token, idf`` = ln(n / (1 + df)) + 1 with n the number of documents."""
    n = docs.select(did).distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    return document_frequency(docs, did, tokens).crossJoin(F.broadcast(n)).select("token", (F.log(F.col("n") / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def hashed_vectors(docs: DataFrame, did: str, tokens: F.Column, weights: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``d, bucket, value``: sparse unit vectors; a token adds (1 + ln tf) * idf with the sign of hash bit 16.

    A document without tokens has no row (the zero vector).
    """
    tf = docs.select(F.col(did).alias("d"), tokens.alias("t")).dropDuplicates(["d"]).select("d", F.explode("t").alias("token")).groupBy("d", "token").agg(F.count("*").alias("c"))
    h = T.fnv1a32(F.col("token"))
    vocabulary = weights.select("token", "idf", (h % dimensions).cast("int").alias("bucket"), F.when(F.shiftright(h, 16).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0).alias("sign"))
    parts = tf.join(vocabulary, "token").groupBy("d", "bucket").agg(F.sum((1 + F.log("c")) * F.col("idf") * F.col("sign")).alias("x"))
    norms = parts.groupBy("d").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return parts.join(norms, "d").filter("norm > 0").select("d", "bucket", (F.col("x") / F.col("norm")).alias("value"))


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, dim, value``: the sum of a group's vectors, scaled to length one, in long form."""
    parts = vectors.select(F.col(group).alias("g"), F.posexplode(vector).alias("dim", "x")).groupBy("g", "dim").agg(F.sum(F.col("x").cast("double")).alias("x"))
    norms = parts.groupBy("g").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return parts.join(norms, "g").select("g", "dim", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(F.col("x")).alias("value"))


def nearest_centroid(vectors: DataFrame, vid: str, vector: str, centres: DataFrame) -> DataFrame:
    """``id, g, similarity``: for each vector the nearest centroid (ties to the lesser group).

    Centroids in long form are gathered to one array each and met by matrix products.
    """
    dense = centres.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("c"))
    rows = vectors.select(F.col(vid).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    found = similarity.nearest(rows, dense.select(F.col("g").cast("long").alias("id"), F.col("c").alias("v")))
    return found.select(F.col("left").alias("id"), F.col("right").alias("g"), "similarity")
