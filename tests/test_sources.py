import gzip
import json
import zlib

from pressloom.operators import geometry
from pressloom.plans.reference import ATOM, RSS
from pressloom.sources import config, feeds, reports

SYNDICATED = """<rss><channel><item><title>Council approves new harbour wall - The Paper</title><link>https://n.example/1</link><source url="https://paper.example">The Paper</source>
<description>Council approves new harbour wall - The Paper</description></item><item><title>UK</title><link>https://n.example/2</link><source url="https://p">The Paper</source></item></channel></rss>"""


def test_parse_feeds(spark):
    bodies = [("r", RSS.encode()), ("a", ATOM.encode()), ("z", gzip.compress(RSS.encode())), ("s", SYNDICATED.encode()), ("bad", b"<html>"), ("none", None)]
    df = spark.createDataFrame(bodies, "poll_id string, body binary")
    items = feeds.parse(df)
    got = {(r["poll_id"], r["position"]): r for r in items.collect()}
    assert set(got) == {("r", 0), ("r", 1), ("z", 0), ("z", 1), ("a", 0), ("s", 0)}
    first = got[("r", 0)]
    assert (first["title"], first["url_canon"], first["standfirst"]) == ("Harbour dredging starts", "https://quay.example/town/dredging?page=2", "Boats wait outside the bar.")
    assert str(first["published_at"]) == "2026-03-05 06:45:00" and first["guid"] == "quay-81"
    assert got[("a", 0)]["url"] == "https://beam.example/light" and str(got[("a", 0)]["published_at"]) == "2026-03-05 06:45:00"
    assert (got[("s", 0)]["title"], got[("s", 0)]["standfirst"]) == ("Council approves new harbour wall", None)
    told = {r["poll_id"]: (r["items"], r["dated"]) for r in feeds.feed_check(df, items).collect()}
    assert told["r"] == (2, 1) and told["bad"] == (0, 0)


def test_decompress():
    body = b"<rss/>" * 50
    assert feeds.decompress(gzip.compress(body)) == body
    assert feeds.decompress(zlib.compress(body), "deflate") == body
    assert feeds.decompress(zlib.compress(body)[2:-4], "deflate") == body
    assert feeds.decompress(b"\x1f\x8bbroken") == b"\x1f\x8bbroken"


def test_config(spark, tmp_path):
    o = tmp_path / "outlets.json"
    o.write_text(json.dumps({"outlets": [{"id": "a", "name": "A", "leaning": 0.5, "market": 0, "weight": 1, "feeds": [{"url": "u", "kind": "top", "curated": True}]}, {"id": "b", "excluded": "why", "feeds": []}]}))
    assert [r["id"] for r in config.outlets(spark, str(o)).collect()] == ["a"]
    assert [tuple(r) for r in config.feeds(spark, str(o)).collect()] == [("a", "u", "top", True, True)]
    t = tmp_path / "taxonomy.json"
    t.write_text(json.dumps({"issues": [{"id": "x", "expect": {"left": "hostile", "right": "favourable", "regression": True}}, {"id": "y", "expect": {"left": "mixed", "right": "mixed", "regression": True}}, {"id": "z"}]}))
    assert {tuple(r) for r in config.expected_direction(config.issues(spark, str(t))).collect()} == {("x", -1), ("y", 0)}
    c = tmp_path / "corrections.json"
    c.write_text(json.dumps({"stories": [{"id": 1, "name": "n", "issue_id": None, "target": "t", "made": "2026-03-01T00:00:00+00:00"}]}))
    assert config.corrections(spark, str(c)).first()["target"] == "t"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    assert reports.to_script(df, "x") == 'x = [{"n":1,"s":"a"},{"n":2,"s":null}];\n'
    assert reports.text_table(df).splitlines()[0].split() == ["n", "s"]
    reports.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    lay = geometry.fit([1, 2, 3], [0.1, 2.0, -2.0], [-3, -2, -1], [1, 2, 3], rows=80, relax=20, rounds=20)
    drawn = reports.svg(lay, {1: "a & b"}, {1: 1.0, 2: -2.0})
    assert drawn.count("<polygon") == 3 and "a &amp; b" in drawn
    assert len(reports.sparkline([0, 1, 2])) == 3 and reports.shade(None) == "#999999"


def test_fetch_source(spark, tmp_path):
    from pressloom.sources import fetch

    body = tmp_path / "feed.xml"
    body.write_text(RSS)
    spark.dataSource.register(fetch.FeedBodies)
    rows = spark.read.format("feed_bodies").option("urls", f"file://{body} file://{tmp_path}/none.xml").load()
    got = {r["url"].rsplit("/", 1)[-1]: r for r in rows.collect()}
    assert got["feed.xml"]["error"] is None and bytes(got["feed.xml"]["body"]) == RSS.encode()
    assert got["none.xml"]["body"] is None and got["none.xml"]["error"]
    assert feeds.parse(rows, "url", "body", "encoding").count() == 2
