"""Configuration files: outlets with their feeds, the taxonomy, corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTLETS = "outlets array<struct<id:string,name:string,leaning:double,market:double,weight:double,excluded:string,feeds:array<struct<url:string,kind:string,curated:boolean>>>>"
TAXONOMY = "issues array<struct<id:string,name:string,target:string,expect:struct<left:string,right:string,regression:boolean,why:string>,includes:array<string>,excludes:array<string>,actors:array<string>>>"
CORRECTIONS = "stories array<struct<id:bigint,name:string,issue_id:string,target:string,made:timestamp,why:string>>"


def _rows(spark: SparkSession, path: str, schema: str, field: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")


def outlets(spark: SparkSession, path: str) -> DataFrame:
    """Outlets in use (those with a reason for exclusion are left out)."""
    return _rows(spark, path, OUTLETS, "outlets").filter(F.coalesce("excluded", F.lit("")) == "")


def feeds(spark: SparkSession, path: str) -> DataFrame:
    return outlets(spark, path).select(F.col("id").alias("outlet_id"), F.explode("feeds").alias("f")).select("outlet_id", "f.url", "f.kind", "f.curated", F.lit(True).alias("active"))


def issues(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, TAXONOMY, "issues")


def expected_direction(issue_rows: DataFrame) -> DataFrame:
    """``issue_id, want`` of the issues that assert a direction: the sign of left minus right."""
    rank = F.create_map(F.lit("hostile"), F.lit(-1), F.lit("mixed"), F.lit(0), F.lit("favourable"), F.lit(1))
    want = F.coalesce(F.signum(rank[F.col("expect.left")] - rank[F.col("expect.right")]).cast("int"), F.lit(0))
    return issue_rows.filter(F.coalesce("expect.regression", F.lit(False))).select(F.col("id").alias("issue_id"), want.alias("want"))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, CORRECTIONS, "stories")
