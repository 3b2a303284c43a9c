import math
import random
from datetime import date, datetime

import numpy as np
from pyspark.sql import functions as F

from pressloom.operators import archive, audit, clustering, dedup, frame, geometry, health, robots, sampling, scoring, similarity, timeline, vectors


# --- copy -------------------------------------------------------------------------------------------
def test_copy_groups_and_rate(spark):
    rows = [
        (1, "a", "https://a/1", "Minister resigns over budget leak today"),
        (2, "b", "https://b/1", "Minister resigns over budget leak today"),
        (3, "c", "https://c/1", "Minister resigns over budget leak today, sources"),
        (4, "a", "https://a/2", "Something else entirely happened elsewhere"),
        (5, "b", "https://b/2", "Weather turns"),
    ]
    df = spark.createDataFrame(rows, "id long, outlet_id string, url_canon string, title string")
    groups = dedup.copy_groups(df)
    assert {r["id"]: (r["group_id"], r["method"]) for r in groups.collect()} == {1: (1, "title"), 2: (1, "title"), 3: (1, "jaccard"), 4: (4, None), 5: (5, None)}
    assert dedup.duplication_rate(groups).first()["rate"] == 0.4
    report = {r["outlet"]: (r["articles"], r["duplicated"]) for r in dedup.outlet_report(df, groups).collect()}
    assert report["TOTAL"] == (5, 3) and report["a"] == (2, 1)


def test_one_outlet_is_no_copy_and_empty(spark):
    df = spark.createDataFrame([(1, "a", None, "Same title of one paper"), (2, "a", "", "Same title of one paper"), (3, "b", None, None), (4, "c", None, "")], "id long, outlet_id string, url_canon string, title string")
    got = {r["id"]: r["group_id"] for r in dedup.copy_groups(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}  # titles without a word share one signature
    assert dedup.duplication_rate(dedup.copy_groups(df.limit(0))).first()["rate"] == 0.0


# --- audit ------------------------------------------------------------------------------------------
PAIRS = "item long, a int, b int"


def kappa(spark, pairs):
    return audit.weighted_kappa(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], PAIRS)).first()["kappa"]


def test_kappa(spark):
    rng = random.Random(20)
    same = [(x, x) for x in (-2, -1, 0, 1, 2, 2)]
    assert kappa(spark, same) == 1.0
    assert kappa(spark, [(-1, -1 if k % 10 else 1) for k in range(50)]) <= 0.01
    assert kappa(spark, [(x, -x) for x in (-2, -1, 1, 2)]) < 0
    assert kappa(spark, [(1, 1), (1, 1)]) == 1.0
    assert kappa(spark, []) is None
    pairs = [(rng.randrange(-2, 3), rng.randrange(-2, 3)) for _ in range(80)]
    n = len(pairs)
    seen = sum((a - b) ** 2 for a, b in pairs)
    chance = sum((a - b) ** 2 for a, _ in pairs for _, b in pairs) / n
    assert math.isclose(kappa(spark, pairs), 1 - seen / chance)


def test_agreement_counts_and_worst(spark):
    a = spark.createDataFrame([(1, -2), (2, None), (3, 1), (4, None)], "item long, score int")
    b = spark.createDataFrame([(1, -2), (2, None), (3, None), (4, 0)], "item long, score int")
    got = audit.agreement(audit.labels_side_by_side(a, b, ["item"])).first()
    assert (got["n_compared"], got["both_abstained"], got["only_a_scored"], got["only_b_scored"]) == (1, 1, 1, 1)
    w = audit.worst(spark.createDataFrame([(1, -2, 2), (2, 0, 0), (3, 1, 1)], PAIRS), ["item"]).collect()
    assert [(r["item"], r["gap"]) for r in w] == [(1, 4)]


def test_calibration_says_whether_one_offset_will_do(spark):
    def skew(shift):
        rows = [(k, float((k % 5) - 2 + shift[k % 4]), float((k % 5) - 2), f"g{k % 4}") for k in range(400)]
        return audit.skew(audit.calibrate(spark.createDataFrame(rows, "item long, a double, b double, g string"), "g")).first()

    even = skew([-0.4] * 4)
    assert even["constant_enough"] and math.isclose(even["mean_offset"], -0.4)
    uneven = skew([-0.8, 0.8, -0.8, 0.8])
    assert not uneven["constant_enough"] and uneven["worst_low"] == "g0"
    assert skew([0, 0, 0, 0])["groups_measured"] == 4


def test_direction(spark):
    outlets = spark.createDataFrame([("l", -0.8), ("r", 0.8), ("m", 0.0)], "id string, leaning double")
    rows = [(i, o, float(s) * (1 if i == "good" else -1 if i == "flip" else 0)) for i in ("good", "flip", "zero") for o, s in (("l", 1.0), ("r", -1.0)) for _ in range(5)] + [("few", "l", 1.0), ("good", "m", None)]
    want = spark.createDataFrame([("good", 1), ("flip", 1), ("zero", 1), ("few", 1), ("none", 0)], "issue_id string, want int")
    got = {r["issue_id"]: r["verdict"] for r in audit.direction(spark.createDataFrame(rows, "issue_id string, outlet_id string, stance double"), outlets, want).collect()}
    assert got == {"good": "ok", "flip": "INVERTED", "zero": "INCONCLUSIVE", "few": "TOO FEW", "none": "NO ASSERTION"}


def test_pearson_and_referee(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "x double, y double")
    assert df.agg(audit.pearson(F.col("x"), F.col("y"))).first()[0] > 0.99
    assert df.limit(2).agg(audit.pearson(F.col("x"), F.col("y"))).first()[0] is None
    items = spark.createDataFrame([(1, 2, None), (2, -1, None), (3, 0, None)], PAIRS)
    key = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)], "item long, direction double")
    assert tuple(audit.referee(items, key, ["item"]).first()) == (1, 1, 1, 1)


# --- samples ----------------------------------------------------------------------------------------
def test_stratified_draw_is_even_and_repeats(spark):
    rows = [(k, f"o{k % 3}", f"i{k % 7}" if k % 11 else None) for k in range(600)] + [(1000 + k, "small", "i1") for k in range(5)]
    df = spark.createDataFrame(rows, "id long, outlet_id string, issue_id string")
    a = {tuple(r) for r in sampling.stratified(df, "id", "outlet_id", "issue_id", n=120).collect()}
    b = {tuple(r) for r in sampling.stratified(df.repartition(7), "id", "outlet_id", "issue_id", n=120).collect()}
    assert a == b
    per = {}
    for _, o, i in a:
        per.setdefault(o, {}).setdefault(i, 0)
        per[o][i] += 1
    assert {o: sum(v.values()) for o, v in per.items()} == {"o0": 30, "o1": 30, "o2": 30, "small": 5}
    assert max(per["o0"].values()) - min(per["o0"].values()) <= 1


def test_whole_groups_packs_and_tiers(spark):
    df = spark.createDataFrame([(k, k // 10) for k in range(200)], "id long, g long")
    got = sampling.whole_groups(df, "id", "g", 35).collect()
    assert len(got) == 40 and len({r["group_id"] for r in got}) == 4
    packs = sampling.fixed_packs(df.withColumn("one", F.lit(1)), "one", [F.col("id")], 20)
    assert packs.groupBy("pack").count().filter("count <> 20").count() == 0
    t = sampling.gap_tiers(spark.createDataFrame([(x,) for x in (10.0, 10.5, 20.0, 21.0, 60.0, None, 10.0)], "v double"), "v")
    assert {r["value"]: r["tier"] for r in t.collect()} == {10.0: 0, 10.5: 0, 20.0: 1, 21.0: 1, 60.0: 2}


# --- health -----------------------------------------------------------------------------------------
def test_feed_health(spark):
    def hourly(feed, hashes, until=49):
        return [(feed * 1000 + h, feed, datetime(2026, 3, 1 + h // 24, h % 24), 20, hashes(h), None) for h in range(until)]

    rows = hourly(1, lambda h: f"x{h}") + hourly(2, lambda h: "same") + hourly(3, lambda h: f"y{h}", until=25)
    rows += [(9001, 4, datetime(2026, 3, 3, 0), 5, None, None), (9002, 4, datetime(2026, 3, 3, 0, 1), 5, None, None)]
    df = spark.createDataFrame(rows, "id long, feed_id long, polled_at timestamp, n_items long, items_hash string, error string")
    got = {r["feed_id"]: (r["not_answering"], r["thin"], r["frozen"]) for r in health.feed_health(df, F.lit("2026-03-03 00:30:00").cast("timestamp")).collect()}
    assert got == {1: (False, False, False), 2: (False, False, True), 3: (True, False, False), 4: (False, False, False)}


def test_positions(spark):
    df = spark.createDataFrame([("p", 3, 0), ("p", None, 1), ("p", 5, 2), ("p", 3, 3), ("p", 4, 4)], "poll string, art long, n int")
    pos = health.dense_positions(df, "poll", "art", [F.col("n")])
    assert {tuple(r) for r in pos.collect()} == {("p", 3, 0), ("p", 5, 1), ("p", 4, 2)}
    assert {tuple(r) for r in archive.restore_positions(spark.createDataFrame([("p", [3, 5, 4])], "poll string, ids array<long>"), "poll", "ids").collect()} == {("p", 0, 3), ("p", 1, 5), ("p", 2, 4)}
    assert len(health.fingerprints(pos).first()["items_hash"]) == 16


# --- frame and timeline -----------------------------------------------------------------------------
def test_shapes_fit_a_line(spark):
    outlets = spark.createDataFrame([("a", -1.0, 0.0, 1.0), ("b", 0.0, 1.0, 1.0), ("c", 1.0, 0.0, 2.0)], "id string, leaning double, market double, weight double")
    rows = [(1, "a", -2.0, "high"), (1, "b", 0.0, "high"), (1, "c", 2.0, "high"), (1, "c", None, None), (2, "a", 1.0, "low"), (3, "a", None, None), (3, "b", None, None)]
    s = {r["story_id"]: r for r in frame.shapes(frame.story_outlets(spark.createDataFrame(rows, "story_id long, outlet_id string, stance double, confidence string")), outlets).collect()}
    assert set(s) == {1, 3}
    assert (s[1]["articles"], s[1]["scored"], s[1]["outlets"]) == (4, 3, 3)
    assert math.isclose(s[1]["stance_hi"], 2 * 0.88) and math.isclose(s[1]["stance_lo"], -2 * 0.88)
    assert math.isclose(s[1]["angle"], math.atan2(1 / 4, 1 / 4)) and s[3]["stance"] is None


def test_carry_stance_and_bridge(spark):
    rows = [(1, "a", date(2026, 3, 1), -1.0, "high"), (2, "b", date(2026, 3, 1), None, None), (3, "b", date(2026, 3, 2), -2.0, "high")]
    df = spark.createDataFrame(rows, "article_id long, outlet_id string, day date, stance double, confidence string").withColumn("story_id", F.lit(1))
    end = F.lit("2026-03-02").cast("date")
    vol = {(r["day"].day): r["vol"] for r in timeline.carried(df, ["story_id"], "day", end).collect()}
    assert vol == {1: 2.0, 2: 2.0}
    calendar = spark.createDataFrame([(date(2026, 3, d), d not in (3, 4, 6)) for d in range(1, 7)], "day date, polled boolean")
    st = {(r["outlet_id"], r["day"].day): r["stance"] for r in timeline.carried_stance(df, ["outlet_id"], "day", calendar.select("day")).collect()}
    assert st[("b", 2)] == -2.0 and ("b", 1) not in st and st[("a", 6)] == -1.0
    series = spark.createDataFrame([(1, date(2026, 3, 2), 2.0), (1, date(2026, 3, 5), 8.0), (1, date(2026, 3, 4), 99.0)], "k long, day date, vol double")
    got = {r["day"].day: r["vol"] for r in timeline.bridged(series, ["k"], calendar).collect()}
    assert got == {1: 0.0, 2: 2.0, 3: 4.0, 4: 6.0, 5: 8.0, 6: 8.0}


def test_risers_and_captions(spark):
    vol = spark.createDataFrame([(1, date(2026, 3, 1), 5.0), (2, date(2026, 3, 1), 5.0), (1, date(2026, 3, 2), 1.0), (2, date(2026, 3, 2), 9.0)], "story_id long, day date, vol double")
    cal = spark.createDataFrame([(date(2026, 3, 1), True), (date(2026, 3, 2), True), (date(2026, 3, 3), False)], "day date, polled boolean")
    e = timeline.risers(vol, cal)
    assert [(r["day"].day, r["story_id"], round(r["rise"], 6)) for r in e.collect()] == [(2, 2, 0.4)]
    heads = spark.createDataFrame([(2, "x", date(2026, 3, 2), "other", 1), (2, "sky", date(2026, 3, 2), "sky says", 2)], "story_id long, outlet_id string, day date, title string, place int")
    names = spark.createDataFrame([(2, "name")], "story_id long, name string")
    assert timeline.captions(e, heads, names).first()["caption"] == "sky says"
    assert timeline.captions(e, heads.limit(0), names).first()["caption"] == "name"


# --- archive ----------------------------------------------------------------------------------------
def test_archive_round_trip_and_difference(spark, tmp_path):
    schema = "article_id long, issue_id string, stance double, seq long, deleted boolean, at timestamp"
    t = datetime(2026, 3, 1)
    lines = spark.createDataFrame([(1, "a", 1.0, 1, None, t), (2, None, 0.5, 2, None, t), (2, None, None, 3, True, datetime(2026, 4, 1)), (3, "a", 1.0, 4, None, t), (3, "a", -1.0, 5, False, t)], schema)
    path = str(tmp_path / "shards")
    assert archive.read_lines(spark, path, schema).count() == 0
    archive.append_lines(lines, path, "at")
    back = archive.read_lines(spark, path, schema).select(*lines.columns)
    assert archive.compare(back, lines).count() == 0
    state = archive.replayed(back, ["article_id", "issue_id"], F.col("seq"), F.col("deleted"))
    assert {(r["article_id"], r["stance"]) for r in state.collect()} == {(1, 1.0), (3, -1.0)}
    had = archive.as_of(back, ["article_id", "issue_id"], F.col("seq"), F.col("at"), F.lit("2026-03-15").cast("timestamp"), F.col("deleted"))
    diff = archive.difference(had, state, ["article_id", "issue_id"], [F.col("stance")], ["stance"])
    assert [tuple(r) for r in diff.collect()] == [(2, None, "deleted")]
    assert archive.difference(state, state, ["article_id", "issue_id"], [F.col("stance")], ["stance"]).count() == 0
    archive.guard(0, lines.limit(0))
    try:
        archive.guard(5, lines.limit(0))
    except RuntimeError:
        pass
    else:
        raise AssertionError("a lost archive must be noticed")


def test_upserts_and_corrections(spark):
    old = spark.createDataFrame([("u1", "top", True), ("u2", "top", True)], "url string, kind string, active boolean")
    new = spark.createDataFrame([("u2", "section", True), ("u3", "top", True)], "url string, kind string, active boolean")
    assert {tuple(r) for r in archive.upsert(old, new, ["url"], "active").collect()} == {("u1", "top", False), ("u2", "section", True), ("u3", "top", True)}
    assert {tuple(r) for r in archive.insert_or_ignore(old, new, ["url"]).collect()} == {("u1", "top", True), ("u2", "top", True), ("u3", "top", True)}
    stories = spark.createDataFrame([(1, "boats", None, "x", None), (2, "tax", "t", "y", None)], "id long, name string, issue_id string, target string, target_conf string")
    scores = spark.createDataFrame([(1, 1, datetime(2026, 1, 1)), (2, 1, datetime(2026, 5, 1)), (3, 2, datetime(2026, 1, 1))], "article_id long, story_id long, scored_at timestamp")
    fixes = spark.createDataFrame([(1, "boats", "b", "z", datetime(2026, 3, 1)), (2, "wrong", "b", "z", datetime(2026, 3, 1))], "id long, name string, issue_id string, target string, made timestamp")
    for _ in range(2):
        stories, scores = archive.correct(stories, scores, fixes)
        assert {tuple(r) for r in stories.collect()} == {(1, "boats", "b", "z", "corrected"), (2, "tax", "t", "y", None)}
        assert {r["article_id"] for r in scores.collect()} == {2, 3}


# --- clusters, identity, layout ---------------------------------------------------------------------
def test_leader_groups_find_planted_stories_in_any_order(spark):
    rng = np.random.default_rng(21)
    rows = []
    for s in range(3):
        c = rng.normal(size=16)
        rows += [(s * 10 + k, f"o{k}", (c + rng.normal(size=16) * 0.2).tolist(), k) for k in range(5 - s)]
    schema = "id long, outlet string, v array<double>, p int"
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, schema).withColumn("w", F.lit(1))
        out = clustering.leader_clusters(df, "w", "id", "outlet", "v", "p", 0.58)
        got = {(r["id"], r["group_key"], r["is_story"]) for r in out.collect()}
        want = want or got
        assert got == want
    assert {k for _, k, _ in want} == {0, 10, 20}
    assert clustering.leader_clusters(df, "w", "id", "outlet", "v", "p", 0.9999).filter("is_story").count() == 0
    names = clustering.provisional_names(out, df.select("id", F.concat(F.lit("Title "), F.col("id").cast("string"), F.lit(" - Paper")).alias("title")))
    assert all(r["name"].startswith("Title ") and " - " not in r["name"] for r in names.collect())


def day_of(spark, clusters, stories, day, **kw):
    frame = spark.createDataFrame(clusters, "key string, centroid array<double>, n long")
    before = stories if stories is not None else spark.createDataFrame([], clustering.STORY)
    chosen, after = clustering.identity_step(frame, before, day, **kw)
    return {r["key"]: r["story_id"] for r in chosen.collect()}, after


def status(stories):
    return {r["id"]: r["status"] for r in stories.collect()}


def test_stories_keep_their_ids(spark):
    e = np.eye(16)
    chosen, stories = day_of(spark, [("a", e[0].tolist(), 3)], None, 0, first_id=321)
    assert chosen == {"a": 321}
    chosen, stories = day_of(spark, [("x", (e[0] + 0.1 * e[1]).tolist(), 1)], stories, 1)
    assert chosen == {"x": 321}
    got = stories.first()
    assert got["n_articles"] == 4 and abs(got["centroid"][1] - 0.035) < 1e-9
    assert status(day_of(spark, [], stories, 3)[1]) == {321: "dormant"}
    _, closed = day_of(spark, [], stories, 7)
    assert status(closed) == {321: "closed"}
    assert day_of(spark, [("y", e[0].tolist(), 1)], closed, 8)[0] == {"y": 322}  # it does not come back
    near = [("p", (0.8 * e[0] + 0.6 * e[5]).tolist(), 1), ("q", (0.8 * e[0] + 0.6 * e[6]).tolist(), 1)]
    assert set(day_of(spark, near, stories, 2)[0].values()) == {321, 322}  # one of two near clusters only


def test_converged_stories_become_the_eldest(spark):
    e = np.eye(16)
    twins = [("m", e[9].tolist(), 1), ("n", (e[9] + 0.1 * e[10]).tolist(), 2), ("z", e[2].tolist(), 1)]
    chosen, stories = day_of(spark, twins, None, 0)
    assert chosen == {"m": 1, "n": 1, "z": 3}
    rows = {r["id"]: r for r in stories.collect()}
    assert rows[2]["status"] == "merged" and rows[2]["merged_into"] == 1 and rows[1]["n_articles"] == 3


def test_both_ways_of_matching_agree(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(30), rng.randrange(30)): round(rng.random(), 1) for _ in range(200)}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "left long, right long, similarity double")
    one = {tuple(r) for r in clustering.greedy_pairs(df).collect()}
    assert one == {tuple(r) for r in clustering.greedy_pairs(df, single_task=0).collect()} and one


def test_blocks_of_vectors_meet_as_a_whole(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(70, 4)), rng.normal(size=(30, 4))
    la = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(900, None), (901, [1.0])], "id long, v array<double>")
    rb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "id long, v array<double>")
    sims = similarity.unit(a) @ similarity.unit(b).T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(sims >= 0.5), strict=True)}
    for sent in (similarity.SENT_BYTES, 0):
        monkeypatch.setattr(similarity, "SENT_BYTES", sent)
        monkeypatch.setattr(similarity, "LEFT_BLOCK", 25)
        monkeypatch.setattr(similarity, "RIGHT_BLOCK", 11)
        assert {(r["left"], r["right"]) for r in similarity.pairs_at_least(la, rb, 0.5).collect()} == want
        assert {r["left"]: r["right"] for r in similarity.nearest(la, rb).collect()} == {i: int(j) for i, j in enumerate(sims.argmax(axis=1))}


def test_lifetimes_and_spread(spark):
    rows = [(datetime(2026, 3, 1), datetime(2026, 3, d), s) for d, s in ((1, "live"), (1, "closed"), (3, "live"), (9, "live"), (9, "merged"))]
    got = clustering.lifetimes(spark.createDataFrame(rows, "f timestamp, l timestamp, s string"), "f", "l", "s").first()
    assert tuple(got) == (4, 3, 9, 9, 2)
    sizes = spark.createDataFrame([(k,) for k in (5, 3, 1, 1)], "n int")
    s = clustering.spread(sizes, "n").first()
    assert (s["groups"], s["articles"], s["biggest"], s["median_size"], s["singletons"]) == (4, 10, 5, 3, 2)


def layout_of(n, seed=0, **kw):
    rng = np.random.default_rng(seed)
    return geometry.fit(list(range(n)), rng.uniform(-3, 3, n), rng.integers(-12, -1, n), rng.uniform(1, 12, n), **kw), rng


def test_areas_match_points_and_spans():
    lay, rng = layout_of(12, rows=120, relax=60, rounds=20)
    x, y, w = lay.x, lay.y, lay.w
    pts = rng.uniform(-1, 1, (40_000, 2))
    pts = pts[(pts**2).sum(axis=1) < 1]
    owner = ((pts[:, :1] - x) ** 2 + (pts[:, 1:] - y) ** 2 - w).argmin(axis=1)
    assert np.abs(geometry.areas(x, y, w, 300) - np.bincount(owner, minlength=12) / len(owner)).max() < 0.02
    for row in (-0.7, 0.0, 0.33):
        for cell, a, b in geometry.spans(x, y, w, row):
            mid = (a + b) / 2
            assert ((mid - x) ** 2 + (row - y) ** 2 - w).argmin() == cell
        total = sum(b - a for _, a, b in geometry.spans(x, y, w, row))
        assert math.isclose(total, 2 * math.sqrt(1 - row * row), rel_tol=1e-6)


def test_fit_gives_the_areas_asked_for():
    rng = np.random.default_rng(3)
    n = 40
    rank = np.sort(rng.integers(-12, -1, n))
    lay = geometry.fit(list(range(n)), rng.uniform(-3, 3, n), rank, rng.uniform(1, 8, n), rows=300)
    told = geometry.check(lay, rows=300)
    assert told["worst"] < 0.02 and told["mean"] < 0.005 and not told["empty"]
    assert geometry.radial_order(lay, rank) > 0.8
    again = geometry.fit(list(range(5, n + 3)), rng.uniform(-3, 3, n - 2), rank[2:], rng.uniform(1, 8, n - 2), rows=200, relax=24, rounds=60, before=lay)
    assert not geometry.check(again, rows=200)["empty"]
    assert len(geometry.outlines(lay)) == n and len(geometry.label_anchors(lay)) == n
    assert geometry.fit([], [], [], []).ids == []


# --- vectors, robots, scoring -----------------------------------------------------------------------
def test_vectors_are_of_length_one(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "id long, t array<string>")
    idf = vectors.rarity(df, "id", F.col("t"))
    v = vectors.hashed_vectors(df, "id", F.col("t"), idf)
    norms = {r["d"]: r["n"] for r in v.groupBy("d").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()}
    assert set(norms) == {1, 2} and all(math.isclose(n, 1.0) for n in norms.values())
    e = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.8, 0.2]), (3, 1, [0.0, 1.0])], "id long, g int, v array<double>")
    near = {r["id"]: r["g"] for r in vectors.nearest_centroid(e, "id", "v", vectors.centroids(e, "g", "v")).collect()}
    assert near == {1: 0, 2: 0, 3: 1}


def test_robots(spark):
    text = "Sitemap: x\nDisallow: /early\nUser-agent: *\r\nDisallow: /private\nno directive\nAllow: /private/open # yes\n\nUSER-AGENT: Bot\nUser-agent: Twin\nDisallow:\n"
    rules = robots.rules(spark.createDataFrame([("s", text), ("none", None)], "site string, text string"))
    told = {(r["agent"], r["kind"], r["prefix"]) for r in rules.collect()}
    assert told == {("*", "disallow", "/private"), ("*", "allow", "/private/open"), ("bot", "disallow", ""), ("twin", "disallow", "")}
    ask = spark.createDataFrame([("s", "Other", "/private/x"), ("s", "Other", "/private/open/1"), ("s", "Bot", "/private/x"), ("s", "Other", "/")], "site string, agent string, path string")
    got = {(r["agent"], r["path"]): (r["via"], r["allowed"]) for r in robots.decisions(rules, ask).collect()}
    assert got == {("other", "/private/x"): ("*", False), ("other", "/private/open/1"): ("*", True), ("bot", "/private/x"): ("bot", True), ("other", "/"): ("*", True)}


def test_scoring_groups_halves_and_quota(spark):
    work = spark.createDataFrame([(k, k // 40, f"title {k}") for k in range(45)], "id long, story long, title string")
    groups = scoring.packed(work, "story", "id")
    assert sorted(groups.groupBy("story").count().collect()) == [(0, 2), (1, 1)]
    assert scoring.score(groups, scoring.fake_scorer).count() == 45
    calls = []

    def refuses_seven(items):
        calls.append(len(items))
        if any(i["id"] == 7 for i in items):
            raise scoring.RequestRefused
        return {i["id"]: 1.0 for i in items}

    got = scoring.answers(refuses_seven, [{"id": k} for k in range(20)], "id")
    assert set(got) == set(range(20)) - {7}

    def quota(items):
        if items[0]["id"] >= 20:
            raise scoring.QuotaReached
        return {i["id"]: 1.0 for i in items}

    assert scoring.score(groups.coalesce(1).orderBy("story", "pack").coalesce(1), quota).count() == 20
    scores = spark.createDataFrame([(1, None, "r1"), (2, "a", "r0")], "article_id long, issue_id string, rubric_version string")
    todo = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "article_id long, issue_id string")
    assert {r["article_id"] for r in scoring.missing(todo, scores, ["article_id", "issue_id"]).collect()} == {3}
    assert {r["article_id"] for r in scoring.missing(todo, scores, ["article_id", "issue_id"], "r1").collect()} == {2, 3}
    assert scoring.costs(spark.createDataFrame([(1_000_000, 500_000)], "tokens_in long, tokens_out long"), 1.0, 4.0).first()["cost"] == 3.0
