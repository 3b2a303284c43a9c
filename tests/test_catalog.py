import os

import pytest
from sidebyside import ROOT, connect, same_rows

from pressloom.plans import catalog

SF = os.path.join(ROOT, "sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_its_query():
    assert set(catalog.core_oracle()) <= set(catalog.core_queries())


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.core_oracle()))
def test_query_equals_sql(spark, con, name):
    same_rows(catalog.core_queries()[name](spark, SF), con, catalog.core_oracle()[name])


def rows(spark, name):
    return catalog.core_queries()[name](spark, SF).collect()


@needs_tables
def test_flagged_polls_hold_the_bounds_and_only_answered_ones(spark, con):
    found = {r["poll_id"] for r in rows(spark, "p1_found")}
    sure = "SELECT DISTINCT id FROM poll WHERE http_status = '200' AND error IS NULL AND (n_items < 0 OR n_items > 50000 OR n_new < 0 OR n_new > n_items OR polled_at < TIMESTAMPTZ '2026-03-01 00:00:00+00' OR polled_at > TIMESTAMPTZ '2030-01-01 00:00:00+00')"
    answered = {r[0] for r in con.execute("SELECT id FROM poll WHERE http_status = '200' AND error IS NULL").fetchall()}
    assert {r[0] for r in con.execute(sure).fetchall()} <= found <= answered
    states = rows(spark, "p1_states")
    assert sum(r["polls"] for r in states) == con.execute("SELECT count(DISTINCT id) FROM poll").fetchone()[0]
    assert sum(r["polls"] - r["normal"] for r in states) == len(found)


@needs_tables
def test_layout_gives_the_areas_asked_for(spark):
    got = rows(spark, "frame_layout")
    total = sum(r["target"] for r in got)
    assert got and all(abs(r["area"] - r["target"] / total) < 0.02 for r in got)


@needs_tables
def test_leader_groups_are_whole(spark, con):
    got = rows(spark, "leader_clusters")
    assert len(got) == con.execute("SELECT count(DISTINCT vec_id) FROM embeddings").fetchone()[0]
    by = {}
    for r in got:
        by.setdefault((r["window"], r["group_key"]), []).append(r)
    assert all(min(x["id"] for x in g) == key[1] and all(x["n"] == len(g) for x in g) for key, g in by.items())


@needs_tables
def test_identity_names_every_cluster_once_a_day(spark, con):
    got = rows(spark, "identity_days")
    assert {(r["day"], r["cluster"]) for r in got} == {(d, f"{d}-{label}") for d, label in con.execute("SELECT DISTINCT vec_id % 5, label FROM embeddings").fetchall()}
    assert len({(r["day"], r["cluster"]) for r in got}) == len(got) and all(r["story_id"] >= 1 for r in got)


@needs_tables
def test_feeds_are_parsed_in_order(spark, con):
    got = rows(spark, "parsed_feeds")
    tops, others = con.execute("SELECT count(*) FILTER (WHERE kind = 'top'), count(*) FILTER (WHERE kind <> 'top') FROM feed").fetchone()
    assert len(got) == 2 * tops + others and {r["position"] for r in got} <= {0, 1}


def test_every_query_is_covered():
    told = {"p1_found", "p1_states", "frame_layout", "leader_clusters", "identity_days", "parsed_feeds"}
    assert set(catalog.core_queries()) - set(catalog.core_oracle()) == told
