"""Append-only archive: monthly JSON lines, replay, change capture by difference, restore and check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append_lines(df: DataFrame, path: str, at: str) -> None:
    """Appends rows as JSON lines under ``month=YYYY-MM`` of ``at``."""
    df.withColumn("month", F.date_format(at, "yyyy-MM")).write.mode("append").partitionBy("month").json(path)


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines of all months; blank lines are skipped, a missing archive is empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def after_cursor(df: DataFrame, key: str, cursor: int) -> DataFrame:
    """Rows not yet exported."""
    return df.filter(F.col(key) > cursor)


def guard(cursor: int, lines: DataFrame) -> None:
    """A cursor without an archive means lost shards: refuse to go on."""
    if cursor > 0 and not lines.take(1):
        raise RuntimeError("the export cursor is set but the archive is empty: shards are missing")


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def replayed(lines: DataFrame, keys: list[str], order: Column, deleted: Column | None = None) -> DataFrame:
    """The last line of each key (null is a key value), without keys whose last line is a tombstone."""
    cols = [c for c in lines.columns if c not in keys]
    last = lines.groupBy(*keys).agg(F.max_by(F.struct(*cols, (F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)).alias("_gone")), order).alias("r"))
    return last.filter("not r._gone").select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


def as_of(lines: DataFrame, keys: list[str], order: Column, at: Column, cutoff: Column, deleted: Column | None = None) -> DataFrame:
    """The state as it was at ``cutoff``: only lines told by then."""
    return replayed(lines.filter(at <= cutoff), keys, order, deleted)


def difference(had: DataFrame, now: DataFrame, keys: list[str], fields: list[Column], names: list[str]) -> DataFrame:
    """Keys with ``change``: 'set' where new or different in ``fields``, 'deleted' where gone.

    ``fields`` say what counts as a change, as expressions over either side; nulls compare as equal.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{p}{k}") for k in keys], F.struct(*[f.alias(n) for f, n in zip(fields, names, strict=True)]).alias(f"{p}sig"), F.lit(True).alias(f"{p}has"))

    a, b = side(had, "a_"), side(now, "b_")
    cond = reduce(lambda x, y: x & y, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys])
    j = a.join(b, cond, "full")
    out = j.select(*[F.when(F.col("b_has"), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in keys],
                   F.when(F.col("b_has").isNull(), "deleted").when(F.col("a_has").isNull() | ~F.col("a_sig").eqNullSafe(F.col("b_sig")), "set").alias("change"))
    return out.filter("change is not null")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """``side, n``: rows only in one of two tables, counted with repeats."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.select(F.lit("only_a").alias("side")).union(right.select(F.lit("only_b"))).groupBy("side").agg(F.count("*").alias("n"))


def restore_positions(polls: DataFrame, poll: str, order: str) -> DataFrame:
    """``poll_id, article_id, position`` from each poll's list of ids."""
    return polls.select(F.col(poll).alias("poll_id"), F.posexplode(order).alias("position", "article_id"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], retire: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; with ``retire`` a key no longer named is kept, False there."""
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.struct(*[F.col(c) for c in cols]).alias("_n"))
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys])
    j = old.withColumn("_o", F.lit(True)).join(n, cond, "full")

    def value(c: str) -> Column:
        kept = F.lit(False) if c == retire else F.col(c)
        return F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(kept).alias(c)

    return j.select(*[F.when(F.col("_n").isNotNull(), F.col(f"_n_{k}")).otherwise(F.col(k)).alias(k) for k in keys], *[value(c) for c in cols])


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there yet (of equal new keys the least row)."""
    cols = [c for c in old.columns if c not in keys]
    fresh = new.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])
    fresh = fresh.join(old.select(*keys), _null_safe(fresh, old, keys), "left_anti")
    return old.select(*keys, *cols).union(fresh.select(*keys, *cols))


def correct(stories: DataFrame, scores: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hand fixes ``id, name, issue_id, target, made``: applied where id and name agree, else skipped.

    A corrected story loses the scores made before the fix. Applying a fix again changes nothing.
    """
    f = fixes.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("issue_id").alias("_issue"), F.col("target").alias("_target"), F.col("made").alias("_made"))
    j = stories.join(f, (F.col("id") == F.col("_id")) & F.col("name").eqNullSafe(F.col("_name")), "left")
    hit = F.col("_id").isNotNull()
    differs = hit & ~(F.col("issue_id").eqNullSafe(F.col("_issue")) & F.col("target").eqNullSafe(F.col("_target")))
    new = {"issue_id": F.when(hit, F.col("_issue")).otherwise(F.col("issue_id")), "target": F.when(hit, F.col("_target")).otherwise(F.col("target")),
           "target_conf": F.when(differs, "corrected").otherwise(F.col("target_conf"))}
    fixed = j.select(*[new.get(c, F.col(c)).alias(c) for c in stories.columns])
    applied = j.filter(hit).select(F.col("_id"), F.col("_made")).distinct()
    stale = scores.join(applied, (F.col("story_id") == F.col("_id")) & (F.col("scored_at") < F.col("_made")), "left_anti")
    return fixed, stale
