from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pressloom.functions import addresses as A
from pressloom.functions import text as T


def one(spark, value, f):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://WWW.Quay.example/town/pier/?utm_source=x&page=2#talk", "https://quay.example/town/pier?page=2"),
        ("https://quay.example/", "https://quay.example/"),
        ("https://quay.example:8080/x//", "https://quay.example:8080/x"),
        ("http://quay.example:80/x?CMP=1&b=2&ns_x=3", "https://quay.example/x?b=2"),
        ("  ", ""),
        (None, ""),
        ("not a url", "not a url"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, url, T.canonical_url) == want


def test_strip_html(spark):
    assert one(spark, "<p>Boats wait <i>outside</i> the bar.</p>", T.strip_html) == "Boats wait outside the bar."
    assert one(spark, "a<script>x<y</script>b &amp;lt; &ldquo;q&rdquo;&nbsp;&mdash;", T.strip_html) == 'a b < "q" -'
    assert one(spark, None, T.strip_html) == ""


def test_trim_standfirst(spark):
    text = "word " * 100
    got = one(spark, text, T.trim_standfirst)
    assert got.endswith("word…") and len(got) <= 401
    assert one(spark, "short", T.trim_standfirst) == "short"
    assert one(spark, None, T.trim_standfirst) is None


def test_dates(spark):
    want = datetime(2026, 3, 5, 6, 45)
    for text in ("Thu, 05 Mar 2026 07:45:00 +0100", "5 Mar 2026 06:45:00 GMT", "2026-03-05T06:45:00Z", "2026-03-05T07:45:00+01:00", "2026-03-05 06:45:00"):
        assert one(spark, text, T.parse_date) == want, text
    for text in ("yesterday", "", None):
        assert one(spark, text, T.parse_date) is None


@pytest.mark.parametrize(
    ("url", "news"),
    [
        ("https://a.example/sport/football/x", False),
        ("https://a.example/tvshowbiz/x", False),
        ("https://a.example/lifestyle/horoscopes/x", False),
        ("https://a.example/news/puzzles/x", False),
        ("https://a.example/politics/x", True),
        ("https://a.example/content/1", True),
        ("https://a.example/commentisfree/x", True),
        ("", True),
        (None, True),
    ],
)
def test_news_by_url(spark, url, news):
    assert one(spark, url, T.news_by_url) is news


def test_news_falls_back_to_words(spark):
    df = spark.createDataFrame([("https://news.google.com/rss/articles/1", "Arsenal win at home", None), ("https://news.google.com/rss/articles/2", "Harbour vote", ""), (None, None, None)], "u string, t string, s string")
    assert [r[0] for r in df.select(T.is_news(F.col("u"), F.col("t"), F.col("s"))).collect()] == [False, True, True]


def test_desk(spark):
    for url, want in (("https://a/comment/x", "comment"), ("https://a/opinion/columnists/x", "comment"), ("https://a/editorials/x", "leader"), ("https://a/news/x", "news"), (None, "news")):
        assert one(spark, url, T.desk) == want


def test_names(spark):
    def name(x):
        return one(spark, x, lambda c: T.clean_name(c, F.lit("old")))

    assert name('"small boats row"') == "Small boats row"
    for bad in ("", None, "Budget", "Fury over budget", "Is it over now?", "one two three four five six seven", "x" * 30 + " " + "y" * 30):
        assert name(bad) == "old"


def test_tokens_signature_and_pairs(spark):
    assert one(spark, "The PM’s new plan, after all", T.title_tokens) == ["pm's", "plan", "all"]
    assert one(spark, "plan PM's", T.title_signature) == one(spark, "The PM’s plan", T.title_signature)
    assert one(spark, "", T.title_signature) == one(spark, "the of and", T.title_signature)
    assert "small_boats" in one(spark, "Record small boats crossing", T.vector_tokens)
    assert one(spark, None, T.vector_tokens) == [] and one(spark, "boats", T.vector_tokens) == ["boats"]


def test_fnv(spark):
    def plain(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    for s in ("", "a", "small_boats", "é", "x" * 500):
        assert one(spark, s, T.fnv1a32) == plain(s)


def test_jaccard_cosine_and_weights(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], [1.0, 0.0], [1.0, 1.0], "low"), ([], ["a"], [0.0, 0.0], [1.0, 1.0], None)], "a array<string>, b array<string>, x array<double>, y array<double>, c string")
    got = df.select(T.jaccard(F.col("a"), F.col("b")), T.cosine(F.col("x"), F.col("y")), T.confidence_weight(F.col("c"))).collect()
    assert [round(v, 6) for v in got[0]] == [0.333333, 0.707107, 0.35] and list(got[1]) == [0.0, 0.0, 0.7]


def test_prominence_local_day_and_json(spark):
    df = spark.createDataFrame([(0,), (5,), (15,), (None,)], "p int")
    assert [r[0] for r in df.select(T.prominence(F.col("p"))).collect()] == [3, 2, 1, 1]
    d = spark.createDataFrame([(datetime(2026, 6, 1, 23, 30),)], "t timestamp").select(T.local_day(F.col("t")), T.day_index(F.col("t"))).first()
    assert (str(d[0]), d[1]) == ("2026-06-02", 2343)
    for text in ('{"k": 3}', 'Sure:\n```json\n{"k": 3}\n```', 'I think {"k": 3} fits'):
        assert one(spark, text, lambda c: T.tolerant_json(c, "k int"))["k"] == 3
    assert one(spark, "no json", lambda c: T.tolerant_json(c, "k int")["k"]) is None


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("https://x.example/p/", "http://www.x.example:443/p#top", True),
        ("https://x.example/uk/old-words-40001", "https://x.example/uk/new-40001", False),
        ("https://x.example/uk/old-words-4000123", "https://x.example/world/new-4000123?utm_source=a", True),
        ("https://x.example/uk/words/a4000123.html", "https://amp.x.example/uk/other/a4000123.html/", True),
        ("https://x.example/story?id=4000123&section=uk", "https://x.example/story/amp?section=uk&id=4000123", True),
        ("https://x.example/a?b=1&c=2", "https://x.example/a?c=2&b=1&fbclid=9", True),
        ("https://x.example/a?b=1", "https://x.example/a?b=2", False),
        ("https://x.example/in%2Dm47al265", "https://x.example/in-m47al265", True),
        ("https://x.example/a", "https://y.example/a", False),
        ("https://x.example/news/budget?p=2", "https://x.example/sport/cup?p=2", False),
        ("https://x.example/news/20260301", "https://x.example/sport/20260301", False),
        ("https://x.example/news/a-4000123", "https://x.example/news/b-c-4000123.html", True),
    ],
)
def test_page_key(spark, a, b, same):
    assert (one(spark, a, A.page_key) == one(spark, b, A.page_key)) is same


def test_entry_key(spark):
    assert one(spark, " URN:UUID:AB-1 ", A.entry_key) == one(spark, "{ab-1}", A.entry_key)
    assert one(spark, "http://x.example/p-4000123/", A.entry_key) == one(spark, "https://www.x.example/q-4000123", A.entry_key)
    for nothing in ("", "0", "N/A", "undefined", "https://x.example/feed", "https://x.example/", None):
        assert one(spark, nothing, A.entry_key) is None
