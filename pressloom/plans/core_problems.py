"""Queries of the general data-processing problems (1, 4, 6) over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.operators import changefeed, spikes, versions
from pressloom.session import table


def poll_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = (F.col("http_status") == "200") & F.col("error").isNull()
    return spikes.flag_readings(table(spark, sf_dir, "poll"), "id", "feed_id", "polled_at", "n_items", "n_new", "items_hash", answered)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poll_flags(spark, sf_dir).filter("_flagged").select(F.col("_id").alias("poll_id"))


def p1_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feed: readings in each state."""
    f = poll_flags(spark, sf_dir).groupBy(F.col("_source").alias("feed_id"))
    return f.agg(F.count("*").alias("polls"), *[F.count_if(F.col("_state") == s).alias(s) for s in spikes.STATES])


def story_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    story = table(spark, sf_dir, "story")
    target = versions.squeeze(F.col("target"))
    attributes = [
        versions.squeeze(F.col("name")),
        F.when(target != "", target),
        F.lower(versions.squeeze(F.col("status"))),
        F.to_date("last_seen"),
    ]
    return versions.validity_intervals(story, "id", "exported_at", "loaded_at", attributes)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = story_versions(spark, sf_dir)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return v.select(F.col("id").alias("story_id"), stamp("valid_from").alias("valid_from"), F.coalesce(stamp("valid_to"), F.lit("")).alias("valid_to"))


def scores_feed() -> changefeed.Feed:
    """The table names no transactions and a line always gives the whole score: a line is a transaction."""
    return changefeed.Feed(keys=("article_id", "issue_id"), seq="seq", moment=F.coalesce("at", "scored_at"), deleted="deleted")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed state at the watermark, with what was held beyond a gap applied when the feed closes."""
    state = changefeed.replay(table(spark, sf_dir, "scores"), scores_feed())
    return state.select("article_id", F.coalesce("issue_id", F.lit("")).alias("issue_id"), "seq")


def p6_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the feed while it is open: nothing beyond the first missing number is exposed."""
    state = changefeed.replay(table(spark, sf_dir, "scores"), scores_feed(), closed=False)
    return state.select("article_id", F.coalesce("issue_id", F.lit("")).alias("issue_id"), "seq")


def p6_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.feed_status(table(spark, sf_dir, "scores"), scores_feed())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_states": p1_states, "p4_found": p4_found, "p6_found": p6_found, "p6_committed": p6_committed, "p6_status": p6_status}


P4_SQL = r"""
WITH told AS (
  SELECT id, exported_at, loaded_at,
         trim(regexp_replace(name, '[\s\p{Z}]+', ' ', 'g')) AS name,
         nullif(trim(regexp_replace(target, '[\s\p{Z}]+', ' ', 'g')), '') AS target,
         lower(trim(regexp_replace(status, '[\s\p{Z}]+', ' ', 'g'))) AS status,
         CAST(last_seen AT TIME ZONE 'UTC' AS DATE) AS seen
  FROM story),
holding AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, exported_at ORDER BY loaded_at DESC) AS r FROM told) WHERE r = 1),
marked AS (
  SELECT *, CASE WHEN row_number() OVER w > 1
      AND name IS NOT DISTINCT FROM lag(name) OVER w AND target IS NOT DISTINCT FROM lag(target) OVER w
      AND status IS NOT DISTINCT FROM lag(status) OVER w AND seen IS NOT DISTINCT FROM lag(seen) OVER w THEN 0 ELSE 1 END AS opens
  FROM holding WINDOW w AS (PARTITION BY id ORDER BY exported_at))
SELECT id AS story_id, strftime(exported_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS valid_from,
       coalesce(strftime(lead(exported_at) OVER (PARTITION BY id ORDER BY exported_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), '') AS valid_to
FROM marked WHERE opens = 1
"""

P6_SQL = """
SELECT article_id, coalesce(issue_id, '') AS issue_id, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id, issue_id ORDER BY coalesce("at", scored_at) DESC NULLS LAST, seq DESC) AS r
  FROM (SELECT DISTINCT article_id, issue_id, seq, "at", scored_at, deleted FROM scores)) AS ranked
WHERE r = 1 AND NOT coalesce(deleted, false)
"""

P6_COMMITTED_SQL = """
WITH n AS (SELECT DISTINCT seq FROM scores WHERE seq >= 1), r AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rn FROM n),
w AS (SELECT coalesce(max(seq) FILTER (WHERE seq = rn), 0) AS top FROM r)
SELECT article_id, coalesce(issue_id, '') AS issue_id, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id, issue_id ORDER BY coalesce("at", scored_at) DESC NULLS LAST, seq DESC) AS r
  FROM (SELECT DISTINCT article_id, issue_id, seq, "at", scored_at, deleted FROM scores, w WHERE seq <= top)) AS ranked
WHERE r = 1 AND NOT coalesce(deleted, false)
"""

P6_STATUS_SQL = """
WITH n AS (SELECT DISTINCT seq FROM scores), r AS (SELECT seq, row_number() OVER (ORDER BY seq) AS rn FROM n),
w AS (SELECT coalesce(max(seq), 0) AS watermark FROM r WHERE seq = rn)
SELECT watermark, max(seq) AS top, count(*) AS lines, max(seq) - count(*) AS missing, count(*) FILTER (WHERE seq > watermark) AS held
FROM n, w GROUP BY watermark
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_SQL, "p6_found": P6_SQL, "p6_committed": P6_COMMITTED_SQL, "p6_status": P6_STATUS_SQL}
