"""Queries of the work lists over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.operators import audit, timeline, worklists
from pressloom.plans import reference as ref
from pressloom.plans import reference_sql as sql
from pressloom.session import table

SINCE = "2026-03-20"


def _since():  # noqa: ANN202
    return F.lit(SINCE).cast("timestamp")


def recent_articles(spark: SparkSession, d: str) -> DataFrame:
    return worklists.recent(ref.articles(spark, d), "published_at", "first_seen", _since()).select("id")


def live_tagged_stories(spark: SparkSession, d: str) -> DataFrame:
    return worklists.live_tagged(ref.story_now(spark, d), _since()).select("story_id")


def untagged_stories(spark: SparkSession, d: str) -> DataFrame:
    return worklists.untagged(ref.story_now(spark, d)).select("story_id")


def open_story_members(spark: SparkSession, d: str) -> DataFrame:
    """Articles of open stories, through a list of ids."""
    m = ref.members(ref.score_state(spark, d))
    return worklists.among(m, worklists.open_stories(ref.story_now(spark, d)), "story_id").select("article_id", "story_id")


def tagging_todo(spark: SparkSession, d: str) -> DataFrame:
    """The 200 untagged stories seen last: a limit that is the feature."""
    rows = worklists.untagged(ref.story_now(spark, d)).select("story_id", "last_seen")
    return worklists.first_of(rows, [F.desc("last_seen"), "story_id"], 200).select("story_id")


def top_titles(spark: SparkSession, d: str) -> DataFrame:
    t = worklists.top_titles(ref.members(ref.score_state(spark, d)), ref.articles(spark, d))
    return t.select("story_id", F.concat_ws(" | ", "titles").alias("titles"))


def article_stories(spark: SparkSession, d: str) -> DataFrame:
    return worklists.article_stories(ref.articles(spark, d), ref.members(ref.score_state(spark, d)), ref.story_now(spark, d))


def active_outlets(spark: SparkSession, d: str) -> DataFrame:
    return worklists.active_outlets(table(spark, d, "feed"))


def next_ids(spark: SparkSession, d: str) -> DataFrame:
    return worklists.next_ids(article=table(spark, d, "article"), poll=table(spark, d, "poll"), story=table(spark, d, "story"))


def replaced_scores(spark: SparkSession, d: str) -> DataFrame:
    """Standing scores of stories' own targets scored anew, as nothing: null issues are replaced as others are."""
    cols = ("article_id", "issue_id", "stance", "rubric_version")
    state = ref.score_state(spark, d).select(*cols)
    new = state.filter("issue_id is null").select("article_id", "issue_id", F.lit(0.0).alias("stance"), F.lit("r9").alias("rubric_version"))
    return worklists.replaced(state, new, ["article_id", "issue_id"])


def timeline_trim(spark: SparkSession, d: str) -> DataFrame:
    """Volumes per day, up to the last day with any."""
    v = timeline.trimmed(ref._volumes(spark, d))
    return v.groupBy("day").agg(F.sum("vol").alias("vol")).select(ref.day("day").alias("day"), ref.r("vol").alias("vol"))


def json_replies(spark: SparkSession, d: str) -> DataFrame:
    """Lists in replies among prose and fences, read item by item."""
    e = table(spark, d, "events")
    reply = F.concat(F.lit("The list:\n```json\n["), F.col("props"), F.lit(","), F.col("props"), F.lit("]\n```\nDone."))
    rows = e.select("event_id", F.posexplode(T.tolerant_json_list(reply, "k long")).alias("pos", "item"))
    return rows.select("event_id", "pos", F.col("item.k").alias("k"))


def kappa_band(spark: SparkSession, d: str) -> DataFrame:
    k = audit.weighted_kappa(ref._pairs(spark, d))
    return k.select("n", audit.kappa_band(F.col("kappa")).alias("band"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        recent_articles, live_tagged_stories, untagged_stories, open_story_members, tagging_todo, top_titles, article_stories, active_outlets, next_ids,
        replaced_scores, timeline_trim, json_replies, kappa_band,
    ]
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    w = sql._with
    since = f"TIMESTAMPTZ '{SINCE} 00:00:00+00'"
    open_ = "coalesce(status, '') NOT IN ('closed', 'merged')"
    return {
        "recent_articles": w(sql.ART) + f" SELECT id FROM art WHERE coalesce(published_at, first_seen) >= {since}",
        "live_tagged_stories": w(sql.NOW) + f" SELECT story_id FROM now_story WHERE status = 'live' AND last_seen >= {since} AND target <> ''",
        "untagged_stories": w(sql.NOW) + f" SELECT story_id FROM now_story WHERE {open_} AND target = ''",
        "open_story_members": w(sql.STATE, sql.MEMBER, sql.NOW) + f" SELECT article_id, story_id FROM mem WHERE story_id IN (SELECT story_id FROM now_story WHERE {open_})",
        "tagging_todo": w(sql.NOW) + f" SELECT story_id FROM now_story WHERE {open_} AND target = '' ORDER BY last_seen DESC NULLS LAST, story_id LIMIT 200",
        "top_titles": w(sql.ART, sql.STATE, sql.MEMBER)
        + ", r AS (SELECT story_id, article_id, row_number() OVER (PARTITION BY story_id ORDER BY article_id) AS rn FROM mem)"
        + " SELECT story_id, coalesce(string_agg(title, ' | ' ORDER BY rn), '') AS titles FROM r JOIN art ON art.id = article_id WHERE rn <= 8 GROUP BY story_id",
        "article_stories": w(sql.ART, sql.STATE, sql.MEMBER, sql.NOW)
        + " SELECT art.id, mem.story_id, ns.name, ns.target FROM art LEFT JOIN mem ON mem.article_id = art.id LEFT JOIN now_story ns ON ns.story_id = mem.story_id",
        "active_outlets": "SELECT DISTINCT outlet_id FROM feed WHERE active",
        "next_ids": 'SELECT \'article\' AS "table", coalesce(max(id), 0) + 1 AS next_id FROM article UNION ALL SELECT \'poll\', coalesce(max(id), 0) + 1 FROM poll UNION ALL SELECT \'story\', coalesce(max(id), 0) + 1 FROM story',
        "replaced_scores": w(sql.STATE)
        + " SELECT article_id, issue_id, CASE WHEN issue_id IS NULL THEN 0.0 ELSE stance END AS stance, CASE WHEN issue_id IS NULL THEN 'r9' ELSE rubric_version END AS rubric_version FROM state",
        "timeline_trim": w(sql.POLLS, sql.CALENDAR, *sql.BY_ISSUE, sql.VOL) + " SELECT strftime(day, '%Y-%m-%d') AS day, round(sum(vol), 6) AS vol FROM vol WHERE day <= (SELECT max(day) FROM vol WHERE vol > 0) GROUP BY 1",
        "json_replies": "SELECT event_id, pos, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events, (VALUES (0), (1)) AS p(pos)",
        "kappa_band": sql.oracle_sql()["agreement_kappa"].join(("SELECT n, CASE WHEN kappa < 0.4 THEN 'ambiguous' WHEN kappa < 0.6 THEN 'usable' WHEN kappa < 0.8 THEN 'good' ELSE 'doubtful' END AS band FROM (", ")")),
    }
