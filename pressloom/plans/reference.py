"""Queries of the engine's own operators over the test tables. Adapters here, operators elsewhere."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import text as T
from pressloom.operators import archive, audit, clustering, dedup, frame, geometry, health, robots, sampling, scoring, similarity, timeline, vectors
from pressloom.operators.versions import squeeze
from pressloom.session import cut, table
from pressloom.sources import feeds

START, END = "2026-03-01", "2030-01-01"
PLACES = 6


def r(c: Column | str) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, PLACES) + F.lit(0.0)


def day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- adapters ---------------------------------------------------------------------------------------
def articles(spark: SparkSession, d: str) -> DataFrame:
    cols = ("outlet_id", "url_canon", "title", "standfirst", "published_at", "first_seen")
    one = table(spark, d, "article").select("id", *cols).groupBy("id").agg(F.min(F.struct(*cols)).alias("r"))
    return one.select("id", "r.*")


def polls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "poll").distinct().filter((F.col("polled_at") >= F.lit(START).cast("timestamp")) & (F.col("polled_at") < F.lit(END).cast("timestamp")))


def moment() -> Column:
    return F.coalesce("at", "scored_at")


def score_state(spark: SparkSession, d: str) -> DataFrame:
    """The scores that stand: one row per article and issue (null-safe)."""
    s = table(spark, d, "scores").withColumn("moment", moment())
    order = F.struct(F.col("moment").isNotNull(), "moment", "seq")
    return archive.replayed(s, ["article_id", "issue_id"], order, F.col("deleted")).drop("deleted")


def story_now(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "story").withColumnRenamed("id", "story_id")
    cols = [c for c in s.columns if c != "story_id"]
    last = s.groupBy("story_id").agg(F.max_by(F.struct(*cols), F.struct("exported_at", "loaded_at", "name", "status")).alias("r"))
    return last.select("story_id", "r.*").withColumn("status", F.lower(squeeze(F.col("status")))).withColumn("target", F.coalesce(squeeze(F.col("target")), F.lit("")))


def members(state: DataFrame) -> DataFrame:
    """Each article's story: that of its latest standing score."""
    m = state.filter("story_id is not null").groupBy("article_id").agg(F.max_by("story_id", F.struct("moment", "seq")).alias("story_id"))
    return m


def story_rows(spark: SparkSession, d: str, by_issue: bool = False) -> DataFrame:
    """Tagged stories with their articles and, left, the scores; by article alone or by article and issue."""
    state = score_state(spark, d)
    story = story_now(spark, d).filter("target <> '' and status <> 'merged'").select("story_id", "name", "target", F.col("issue_id").alias("story_issue"))
    rows = members(state).join(story, "story_id").join(articles(spark, d).withColumnRenamed("id", "article_id"), "article_id")
    s = state.select(F.col("article_id").alias("_a"), F.col("issue_id").alias("_i"), "stance", "confidence", "desk")
    cond = F.col("article_id") == F.col("_a")
    if by_issue:
        cond = cond & F.col("story_issue").eqNullSafe(F.col("_i"))
    return rows.join(s, cond, "left").drop("_a", "_i")


# --- text and filing --------------------------------------------------------------------------------
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("id", T.canonical_url(F.col("url_canon")).alias("url"))


def strip_html(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").distinct()
    return docs.select("doc_id", F.md5(T.strip_html(F.col("text"))).alias("digest"))


def standfirst_trim(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("id", T.trim_standfirst(F.col("standfirst"), 120).alias("standfirst"))


def article_filing(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url_canon")
    return articles(spark, d).select(
        "id", T.section(u).alias("section"), T.news_by_url(u).alias("by_url"), T.news_by_text(F.col("title"), F.col("standfirst")).alias("by_text"),
        T.is_news(u, F.col("title"), F.col("standfirst")).alias("news"), T.desk(u).alias("desk"),
    )


def news_split(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d).withColumn("news", T.is_news(F.col("url_canon"), F.col("title"), F.col("standfirst")))
    return a.groupBy("outlet_id").agg(F.count_if("news").alias("news"), F.count_if(~F.col("news")).alias("other"))


def title_signature(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).select("id", T.title_signature(F.col("title")).alias("sig"), F.size(T.title_tokens(F.col("title"))).alias("tokens"))


def story_names(spark: SparkSession, d: str) -> DataFrame:
    return story_now(spark, d).select("story_id", T.clean_name(F.col("name"), F.lit("(unnamed)")).alias("name"))


def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written as feeds write them and read back."""
    a = articles(spark, d)
    rfc = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return a.filter(F.year("published_at").between(1000, 9999)).select("id", T.parse_date(rfc).alias("from_rfc"), T.parse_date(iso).alias("from_iso"))


def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    reply = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```"))
    return e.select("event_id", T.tolerant_json(reply, "k long").getField("k").alias("k"))


def local_days(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d)
    return a.groupBy(day(T.local_day(F.col("first_seen"))).alias("day"), T.day_index(F.col("first_seen")).alias("day_index")).agg(F.count("*").alias("n"))


# --- copy and vectors -------------------------------------------------------------------------------
def dup_exact(spark: SparkSession, d: str) -> DataFrame:
    return dedup.same_key_groups(articles(spark, d)).drop("key")


def dup_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.similar_title_pairs(articles(spark, d))


def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copy_groups(articles(spark, d))


def duplication_rate(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplication_rate(dedup.copy_groups(articles(spark, d))).withColumn("rate", r("rate"))


def outlet_report(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d)
    return dedup.outlet_report(a, cut(dedup.copy_groups(a), "groups")).withColumn("dup_share", r("dup_share"))


def _headline() -> Column:
    return T.vector_tokens(F.concat_ws(" ", "title", "standfirst"))


def token_rarity(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d)
    return vectors.rarity(a, "id", _headline()).join(vectors.document_frequency(a, "id", _headline()), "token").select("token", "df", r("idf").alias("idf"))


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    # tokens are read three times below: made once
    a = cut(articles(spark, d).select("id", _headline().alias("tokens")), "tokens")
    tokens = F.col("tokens")
    return vectors.hashed_vectors(a, "id", tokens, vectors.rarity(a, "id", tokens)).select(F.col("d").alias("id"), "bucket", r("value").alias("value"))


def token_hash(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d)
    return a.select(F.explode(F.array_distinct(T.title_tokens(F.col("title")))).alias("token")).distinct().select("token", T.fnv1a32(F.col("token")).alias("h"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.centroids(e, "label", "embedding").select(F.col("g").alias("label"), "dim", r("value").alias("value"))


def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.nearest_centroid(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding")).select(F.col("id").alias("vec_id"), F.col("g").alias("label"), r("similarity").alias("similarity"))


def cosine_search(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector against all: those of cosine 0.3 or more, by matrix products."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    found = similarity.pairs_at_least(e, e.filter("id % 100 = 0"), 0.3).filter("left <> right")
    return found.select(F.col("right").alias("query"), F.col("left").alias("vec_id"), r("similarity").alias("similarity"))


# --- feeds and polls --------------------------------------------------------------------------------
def feed_health(spark: SparkSession, d: str) -> DataFrame:
    p = polls(spark, d)
    now = p.agg(F.max("polled_at").alias("now"))
    h = health.feed_health(p.join(F.broadcast(now), F.lit(True)), F.col("now"))  # one row
    return h.withColumn("last_ok", F.date_format("last_ok", "yyyy-MM-dd HH:mm:ss")).withColumn("last_changed", F.date_format("last_changed", "yyyy-MM-dd HH:mm:ss"))


def last_good_poll(spark: SparkSession, d: str) -> DataFrame:
    g = health.last_good_poll(table(spark, d, "feed"), table(spark, d, "outlet"), polls(spark, d), F.lit("2026-03-25").cast("timestamp"))
    return g.withColumn("last_good", F.date_format("last_good", "yyyy-MM-dd HH:mm:ss"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    return health.dense_positions(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", [F.col("l_linenumber"), F.col("l_partkey")])


def best_position(spark: SparkSession, d: str) -> DataFrame:
    return health.best_position(positions(spark, d)).withColumn("prominence", T.prominence(F.col("best")))


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return health.fingerprints(positions(spark, d))


def upsert_feeds(spark: SparkSession, d: str) -> DataFrame:
    """A new specification keeps two of three feeds, adds one each: the rest is retired."""
    f = table(spark, d, "feed").select("url", "outlet_id", "kind", "active")
    kept = f.filter(F.pmod(F.length("url"), F.lit(3)) != 0).withColumn("kind", F.lit("top")).withColumn("active", F.lit(True))
    added = f.select(F.concat("url", F.lit("?new")).alias("url"), "outlet_id", F.lit("section").alias("kind"), F.lit(True).alias("active"))
    return archive.upsert(f, kept.union(added), ["url"], retire="active")


# --- stories ----------------------------------------------------------------------------------------
def frame_stories(spark: SparkSession, d: str) -> DataFrame:
    s = frame.shapes(frame.story_outlets(story_rows(spark, d)), table(spark, d, "outlet"))
    return s.select("story_id", "articles", "scored", "outlets", *[r(c).alias(c) for c in ("angle", "stance", "stance_lo", "stance_hi")])


def frame_top(spark: SparkSession, d: str) -> DataFrame:
    s = frame.shapes(frame.story_outlets(story_rows(spark, d)), table(spark, d, "outlet"))
    return frame.rings(frame.top_shapes(s)).select("story_id", "articles", "outlets", r("ring").alias("ring"))


def frame_layout(spark: SparkSession, d: str) -> DataFrame:
    """The drawn frame: seeds, weights and areas of the top stories (a report of at most 40 rows)."""
    s = frame.top_shapes(frame.shapes(frame.story_outlets(story_rows(spark, d)), table(spark, d, "outlet"))).toPandas()
    rank = -s["outlets"].to_numpy()
    lay = geometry.fit(s["story_id"].tolist(), s["angle"].to_numpy(), rank, s["articles"].to_numpy(), rows=360, relax=420, rounds=140)
    got = geometry.check(lay)["areas"] if len(s) else np.empty(0)
    rows = [(int(i), float(x), float(y), float(w), float(t), float(g)) for i, x, y, w, t, g in zip(lay.ids, lay.x, lay.y, lay.w, lay.target, got, strict=True)]
    return spark.createDataFrame(rows, "story_id long, x double, y double, w double, target double, area double")


def member_counts(spark: SparkSession, d: str) -> DataFrame:
    n = members(score_state(spark, d)).groupBy("story_id").agg(F.count("*").alias("n"))
    return story_now(spark, d).select("story_id").join(n, "story_id", "left").select("story_id", F.coalesce("n", F.lit(0)).alias("n"))


def story_lifetimes(spark: SparkSession, d: str) -> DataFrame:
    return clustering.lifetimes(story_now(spark, d), "first_seen", "last_seen", "status")


def story_spread(spark: SparkSession, d: str) -> DataFrame:
    s = clustering.spread(member_counts(spark, d).filter("n > 0"), "n")
    return s.withColumn("biggest_share", r("biggest_share"))


def _calendar(spark: SparkSession, d: str) -> DataFrame:
    good = polls(spark, d).filter("error is null and n_items > 0").select(T.local_day(F.col("polled_at")).alias("day"), F.lit(True).alias("p")).distinct()
    ends = table(spark, d, "article").agg(F.min(T.local_day(F.col("first_seen"))).alias("a"), F.max(T.local_day(F.col("first_seen"))).alias("z"))
    days = ends.select(F.explode(F.sequence("a", "z")).alias("day"))
    return days.join(good, "day", "left").select("day", F.coalesce("p", F.lit(False)).alias("polled"))


def _history(spark: SparkSession, d: str) -> DataFrame:
    rows = story_rows(spark, d, by_issue=True)
    return rows.withColumn("day", T.local_day(F.col("first_seen")))


def _volumes(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "article").agg(F.max(T.local_day(F.col("first_seen")))).first()[0]
    return timeline.carried(_history(spark, d).select("story_id", "article_id", "day").distinct(), ["story_id"], "day", F.lit(last))


def history_volume(spark: SparkSession, d: str) -> DataFrame:
    return _volumes(spark, d).select("story_id", day("day").alias("day"), r("vol").alias("vol"))


def history_stance(spark: SparkSession, d: str) -> DataFrame:
    h = _history(spark, d).select("outlet_id", "article_id", "day", "stance", "confidence")
    return timeline.carried_stance(h, ["outlet_id"], "day", _calendar(spark, d).select("day")).select("outlet_id", day("day").alias("day"), r("stance").alias("stance"))


def gap_bridge(spark: SparkSession, d: str) -> DataFrame:
    h = _history(spark, d).select("outlet_id", "article_id", "day").distinct()
    v = timeline.carried(h, ["outlet_id"], "day")
    return timeline.bridged(v, ["outlet_id"], _calendar(spark, d)).select("outlet_id", day("day").alias("day"), r("vol").alias("vol"))


def top_per_day(spark: SparkSession, d: str) -> DataFrame:
    return timeline.day_leaders(_volumes(spark, d), 5).select(day("day").alias("day"), "story_id", r("vol").alias("vol"), "place")


def risers(spark: SparkSession, d: str) -> DataFrame:
    rise = timeline.risers(cut(_volumes(spark, d), "volumes"), _calendar(spark, d), 0.001)
    return rise.select(day("day").alias("day"), "story_id", r("rise").alias("rise"))


def headlines(spark: SparkSession, d: str) -> DataFrame:
    h = _history(spark, d).withColumn("prominence", T.prominence(F.pmod("article_id", F.lit(20))))
    h = h.groupBy("story_id", "outlet_id", "article_id").agg(F.max("day").alias("day"), F.max("prominence").alias("prominence"), F.min("title").alias("title"))
    return timeline.headlines(h, 3).select("story_id", "outlet_id", "article_id", day("day").alias("day"), "prominence", "place")


def event_captions(spark: SparkSession, d: str) -> DataFrame:
    h = _history(spark, d).select("story_id", "outlet_id", "article_id", "day", "title").distinct().withColumn("place", F.col("article_id"))
    e = timeline.risers(cut(_volumes(spark, d), "volumes"), _calendar(spark, d), 0.001)
    return timeline.captions(e, h, story_now(spark, d), ("heron", "ledger")).select(day("day").alias("day"), "story_id", "caption")


# --- scores -----------------------------------------------------------------------------------------
def _labels(spark: SparkSession, d: str, model: str) -> DataFrame:
    s = table(spark, d, "scores").withColumn("moment", moment()).filter(F.col("model") == model)
    last = s.groupBy("article_id", "issue_id").agg(F.max_by(F.struct("stance"), F.struct("moment", "seq")).alias("v"))
    return last.select("article_id", "issue_id", F.bround("v.stance", 0).cast("int").alias("score"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """What two labellers said of the same article and issue, in whole points."""
    pairs = audit.labels_side_by_side(_labels(spark, d, "judge-a"), _labels(spark, d, "judge-b"), ["article_id", "issue_id"])
    return cut(pairs, "labels")


def agreement_kappa(spark: SparkSession, d: str) -> DataFrame:
    return audit.weighted_kappa(_pairs(spark, d)).select("n", r("kappa").alias("kappa"))


def agreement_summary(spark: SparkSession, d: str) -> DataFrame:
    a = audit.agreement(_pairs(spark, d))
    return a.select(*[r(c).alias(c) if c in ("exact", "within_1", "same_sign") else c for c in a.columns])


def worst_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return audit.worst(_pairs(spark, d), ["article_id", "issue_id"])


def _pairs_by_outlet(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).join(articles(spark, d).select(F.col("id").alias("article_id"), "outlet_id"), "article_id")


def calibrate(spark: SparkSession, d: str) -> DataFrame:
    c = audit.calibrate(_pairs_by_outlet(spark, d), "outlet_id")
    return c.select("grp", "n", *[r(x).alias(x) for x in ("bias", "mae", "sd", "within_1", "same_sign")])


def skew_verdict(spark: SparkSession, d: str) -> DataFrame:
    s = audit.skew(audit.calibrate(_pairs_by_outlet(spark, d), "outlet_id"), least=3)
    return s.select("groups_measured", r("spread").alias("spread"), "worst_low", "worst_high", r("mean_offset").alias("mean_offset"), "constant_enough")


def offset_stability(spark: SparkSession, d: str) -> DataFrame:
    """The same test per issue instead of per outlet."""
    s = audit.skew(audit.calibrate(_pairs(spark, d), "issue_id"), least=3)
    return s.select("groups_measured", r("spread").alias("spread"), r("mean_offset").alias("mean_offset"), "constant_enough")


def outlet_means(spark: SparkSession, d: str) -> DataFrame:
    return audit.by_outlet(_pairs_by_outlet(spark, d)).select("outlet_id", r("before").alias("before"), r("after").alias("after"), "n")


def switch_verdict(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    v = audit.switch_verdict(audit.weighted_kappa(p), audit.agreement(p), audit.by_outlet(_pairs_by_outlet(spark, d)))
    return v.select(r("kappa").alias("kappa"), r("same_sign").alias("same_sign"), r("corr").alias("corr"), "verdict")


def referee(spark: SparkSession, d: str) -> DataFrame:
    key = _pairs(spark, d).filter("b is not null and b <> 0").select("article_id", "issue_id", F.signum("b").alias("direction"))
    return audit.referee(_pairs(spark, d), key, ["article_id", "issue_id"])


def consensus(spark: SparkSession, d: str) -> DataFrame:
    both = _labels(spark, d, "judge-a").union(_labels(spark, d, "judge-b"))
    return audit.consensus(both, ["article_id", "issue_id"])


def direction_test(spark: SparkSession, d: str) -> DataFrame:
    s = score_state(spark, d).filter("issue_id is not null").join(articles(spark, d).select(F.col("id").alias("article_id"), "outlet_id"), "article_id")
    want = s.select("issue_id").distinct().withColumn("want", (F.pmod(F.length("issue_id"), F.lit(3)) - 1).cast("int"))
    t = audit.direction(s, table(spark, d, "outlet"), want)
    return t.withColumn("diff", r("diff"))


def leaning_order(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of outlets' leaning and mean stance."""
    s = score_state(spark, d).join(articles(spark, d).select(F.col("id").alias("article_id"), "outlet_id"), "article_id")
    m = s.groupBy("outlet_id").agg(F.avg("stance").alias("stance")).join(table(spark, d, "outlet").select(F.col("id").alias("outlet_id"), "leaning"), "outlet_id")
    return frame.spearman(m.filter("stance is not null"), "leaning", "stance", "outlet_id").select("n", r("rho").alias("rho"))


def unscored_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles of tagged stories without a score on the story's issue under rubric r5."""
    state = score_state(spark, d)
    story = story_now(spark, d).filter("target <> ''").select("story_id", "issue_id")
    work = members(state).join(story, "story_id").select("article_id", "story_id", "issue_id")
    return scoring.missing(work, state, ["article_id", "issue_id"], "r5").select("article_id", "story_id")


def group_packs(spark: SparkSession, d: str) -> DataFrame:
    return sampling.fixed_packs(members(score_state(spark, d)), "story_id", [F.col("article_id")]).select("article_id", "story_id", "pack")


def scored_by_model(spark: SparkSession, d: str) -> DataFrame:
    """The work list through the packing, the retries and the deterministic model."""
    m = members(score_state(spark, d)).join(articles(spark, d).select(F.col("id").alias("article_id"), "title"), "article_id")
    groups = scoring.packed(m.select(F.col("article_id").alias("id"), "story_id", "title"), "story_id", "id")
    return scoring.score(groups, scoring.fake_scorer).withColumnRenamed("id", "article_id")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    s = score_state(spark, d).groupBy("article_id").agg(F.min("issue_id").alias("issue_id"))
    return sampling.stratified(articles(spark, d).join(s, F.col("id") == F.col("article_id")), "id", "outlet_id", "issue_id")


def sample_coverage(spark: SparkSession, d: str) -> DataFrame:
    return sampling.coverage(stratified_sample(spark, d))


def whole_story_draw(spark: SparkSession, d: str) -> DataFrame:
    return sampling.whole_groups(members(score_state(spark, d)), "article_id", "story_id", 300)


def gap_tiers(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select((F.col("p_size") * F.col("p_size")).cast("double").alias("v"))
    return sampling.gap_tiers(sizes, "v").select(F.col("value").alias("size"), "tier")


# --- archive ----------------------------------------------------------------------------------------
def archive_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The scores as they were told up to the end of March."""
    s = table(spark, d, "scores").withColumn("moment", moment())
    out = archive.as_of(s, ["article_id", "issue_id"], F.struct("moment", "seq"), F.col("moment"), F.lit("2026-03-31").cast("timestamp"), F.col("deleted"))
    return out.select("article_id", "issue_id", "seq")


def archive_difference(spark: SparkSession, d: str) -> DataFrame:
    """What changed in the scores since the end of March, deletions included."""
    s = table(spark, d, "scores").withColumn("moment", moment())
    had = archive.as_of(s, ["article_id", "issue_id"], F.struct("moment", "seq"), F.col("moment"), F.lit("2026-03-31").cast("timestamp"), F.col("deleted"))
    now = score_state(spark, d)
    return archive.difference(had, now, ["article_id", "issue_id"], [F.col("stance"), F.col("confidence"), F.col("rubric_version")], ["stance", "confidence", "rubric_version"])


def archive_restore(spark: SparkSession, d: str) -> DataFrame:
    """Positions back from each poll's list of ids."""
    listed = positions(spark, d).groupBy("poll_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "article_id"))), lambda s: s["article_id"]).alias("ids"))
    return archive.restore_positions(listed, "poll_id", "ids")


def corrected_stories(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of fixes: by a story's right name, and by a wrong one, which must not apply."""
    s = story_now(spark, d).withColumnRenamed("story_id", "id").select("id", "name", "issue_id", "target", "target_conf")
    fix = s.filter("id % 50 = 0").select("id", F.when(F.col("id") % 100 == 0, F.col("name")).otherwise("someone else").alias("name"), F.lit("corrected-issue").alias("issue_id"), F.lit("corrected target").alias("target"), F.lit("2026-04-01").cast("timestamp").alias("made"))
    scores = score_state(spark, d).select("article_id", "issue_id", "story_id", "scored_at")
    fixed, kept = archive.correct(s, scores, fix)
    n = kept.groupBy(F.col("story_id").alias("id")).agg(F.count("*").alias("scores"))
    return fixed.join(n, "id", "left").select("id", "issue_id", "target", "target_conf", F.coalesce("scores", F.lit(0)).alias("scores"))


# --- clustering, sources, robots --------------------------------------------------------------------
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("w", F.pmod("vec_id", F.lit(5)))
    c = clustering.leader_clusters(e, "w", "vec_id", "label", "embedding", "vec_id", 0.58)
    return c.select("window", "id", "group_key", "n", "outlets", "is_story")


def identity_days(spark: SparkSession, d: str) -> DataFrame:
    """Stories kept over five days; each day's clusters are its labels' centroids."""
    e = table(spark, d, "embeddings").withColumn("day", F.pmod("vec_id", F.lit(5)).cast("int")).withColumn("g", F.concat_ws("-", "day", "label"))
    cells = vectors.centroids(e, "g", "embedding").groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("c"))
    sizes = e.groupBy("g", "day").agg(F.count("*").alias("n"))
    seen = cut(cells.join(sizes, "g").select("day", F.col("g").alias("key"), F.col("c").alias("centroid"), "n"), "days")
    stories, out = spark.createDataFrame([], clustering.STORY), None
    for day in range(5):
        chosen, stories = clustering.identity_step(seen.filter(F.col("day") == day).drop("day"), stories, day)
        told = chosen.select(F.lit(day).alias("day"), F.col("key").alias("cluster"), "story_id")
        out = told if out is None else out.union(told)
    return out


RSS = """<rss version="2.0"><channel>
<item><title>Harbour dredging starts</title><link>http://WWW.Quay.example/town/dredging/?utm_source=feed&amp;page=2#talk</link><description>&lt;p&gt;Boats wait &lt;i&gt;outside&lt;/i&gt; the bar.&lt;/p&gt;</description><pubDate>Thu, 05 Mar 2026 07:45:00 +0100</pubDate><guid>quay-81</guid></item>
<item><title>An item that leads nowhere</title></item><item><title>Ferry timetable</title><link>https://quay.example/</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Lighthouse repainted</title><link href="https://beam.example/light"/><updated>2026-03-05T06:45:00Z</updated><id>tag:beam</id></entry></feed>"""


def parsed_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Two small bodies per feed of the table, parsed in feed order."""
    f = table(spark, d, "feed").select(F.col("id").cast("string").alias("poll_id"), F.when(F.col("kind") == "top", F.lit(RSS)).otherwise(F.lit(ATOM)).cast("binary").alias("body"))
    return feeds.parse(f).select("poll_id", "position", "title", "url_canon", "standfirst", "published_at", "guid")


ROBOTS = "User-agent: *\nDisallow: /front\nAllow: /front/1\n\nUser-agent: ReaderBot\nUser-agent: OtherBot\nDisallow: /home/\nDisallow:\n"


def robots_decisions(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed").select(F.lit("site").alias("site"), F.explode(F.array(F.lit("ReaderBot"), F.lit("Anyone"))).alias("agent"), F.concat(F.lit("/"), T.section(F.col("url"))).alias("path"))
    return robots.decisions(robots.rules(spark.createDataFrame([("site", ROBOTS)], "site string, text string")), f)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        canonical_url, strip_html, standfirst_trim, article_filing, news_split, title_signature, story_names, parse_dates, tolerant_json, local_days,
        dup_exact, dup_similar_pairs, dup_groups, duplication_rate, outlet_report, token_rarity, hashed_vectors, token_hash, centroids, nearest_centroid,
        cosine_search, feed_health, last_good_poll, positions, best_position, fingerprints, upsert_feeds, frame_stories, frame_top, frame_layout,
        member_counts, story_lifetimes, story_spread, history_volume, history_stance, gap_bridge, top_per_day, risers, headlines, event_captions,
        agreement_kappa, agreement_summary, worst_disagreements, calibrate, skew_verdict, offset_stability, outlet_means, switch_verdict, referee,
        consensus, direction_test, leaning_order, unscored_articles, group_packs, scored_by_model, stratified_sample, sample_coverage,
        whole_story_draw, gap_tiers, archive_as_of, archive_difference, archive_restore, corrected_stories, leader_clusters, identity_days,
        parsed_feeds, robots_decisions,
    ]
    return {q.__name__: q for q in named}
