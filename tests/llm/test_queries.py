import os

import pytest
from sidebyside import ROOT, connect, same_rows

from pressloom.llm import packing, queries
from pressloom.plans.catalog import in_utc

SF = os.path.join(ROOT, "sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_rows(in_utc(queries.queries()[name])(spark, SF), connect(SF), queries.oracle_sql()[name])


def rows(spark, name):
    return in_utc(queries.queries()[name])(spark, SF).collect()


@pytest.fixture(scope="module")
def texts():
    return dict(connect(SF).execute("SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall())


def test_sentences_cover_every_text_once(spark, texts):
    by = {}
    for r in rows(spark, "p9_found"):
        by.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    assert set(by) == {d for d, t in texts.items() if t.strip()}
    for d, spans in by.items():
        spans.sort()
        text, at, rest = texts[d], 0, ""
        for a, b in spans:
            assert at <= a < b <= len(text) and text[a:b] == text[a:b].strip()
            rest, at = rest + text[at:a], b
        assert not (rest + text[at:]).strip()


def test_matches_are_those_found_and_long_enough(spark):
    found = {(r["doc_id"], r["item_id"]) for r in rows(spark, "p8_found")}
    got = rows(spark, "p8_matches")
    assert found and {(r["doc_id"], r["item_id"]) for r in got} == found
    assert all(r["longest"] >= 1 and r["at"] >= 0 and r["places"] >= 1 for r in got)


def test_clusters_are_described_whole(spark):
    members = {}
    for r in rows(spark, "p3_found"):
        members.setdefault(r["cluster_id"], set()).add(r["article_id"])
    told = {r["cluster_id"]: r for r in rows(spark, "p3_clusters")}
    assert {c: len(m) for c, m in members.items()} == {c: t["size"] for c, t in told.items()}
    assert all(set(t["typical"]) <= members[c] and t["chief"] in members[c] and t["peaks"] >= 1 for c, t in told.items())


def test_containers_hold_every_piece_once(spark, texts):
    got = rows(spark, "p7_containers")
    filled, pieces = {}, set()
    for r in got:
        filled[r["container"]] = filled.get(r["container"], 0) + r["size"]
        pieces.add((r["doc_id"], r["piece"]))
    assert len(pieces) == len(got) and set(texts) <= {d for d, _ in pieces}
    assert max(filled.values()) <= packing.CAPACITY
    fill = rows(spark, "p7_fill")[0].asDict()
    assert len(filled) <= 1.1 * -(-sum(filled.values()) // packing.CAPACITY) + 1 and fill["containers"] == len(filled)


def test_every_query_is_covered():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"p3_clusters", "p7_containers", "p7_fill", "p8_matches", "p9_found"}
