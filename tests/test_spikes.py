from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from pressloom.operators import spikes

SCHEMA = "id long, feed_id long, polled_at timestamp, http_status string, n_items long, n_new long, items_hash string, error string, _source int"
T0 = datetime(2026, 3, 1)


def answered():
    return (F.col("http_status") == "200") & F.col("error").isNull()


def flags(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = spikes.flag_readings(df, "id", "feed_id", "polled_at", "n_items", "n_new", "items_hash", answered())
    return {r["_id"]: r["_state"] for r in out.collect()}


def series(feed, hours=24 * 40, seed=0, level=40.0, base=0):
    rng = np.random.default_rng(seed)
    rows = []
    for h in range(hours):
        up = 1.8 if h > hours // 2 else 1.0  # a lasting change of level
        n = int(level * up * (1 + 0.3 * np.sin(h / 24 * 2 * np.pi)) * np.exp(rng.normal(0, 0.05)))
        rows.append([base + h, feed, T0 + timedelta(hours=h), "200", n, 1, f"{feed}-{h}", None, 1])
    return rows


def test_planted_cases_are_found_and_rhythm_is_not(spark):
    rows = series(1)
    rows[100][4] = 400
    rows[300][4] = 2
    rows[301][4] = 2
    rows[500][4] = 0
    for h in range(600, 650):  # stuck contents
        rows[h][6], rows[h][4] = rows[599][6], rows[599][4]
    for h in range(760, 800):  # stuck value, fresh contents
        rows[h][4] = rows[759][4]
    rows[850][4] = -3
    rows[851][5] = 10_000
    rows[852][2] = datetime(2080, 1, 1)
    rows[853][2] = datetime(1970, 1, 1)
    rows[20][3], rows[20][7], rows[20][4] = "503", "http 503", 0
    got = flags(spark, [tuple(r) for r in rows] + [tuple(rows[5])])
    flagged = {k: v for k, v in got.items() if v != "normal"}
    want = {100, 300, 301, 500, *range(600, 650), *range(760, 800), 850, 851, 852, 853}
    assert set(flagged) == want
    assert flagged[100] == "spike" and flagged[620] == "stuck_contents" and flagged[780] == "stuck_value" and flagged[852] == "out_of_range"


def test_slow_source_is_not_stuck(spark):
    rows = series(2)
    for h in range(len(rows)):  # new contents every 30 hours is usual here
        rows[h][6], rows[h][4] = f"c{h // 30}", 40 + h // 30 % 3
    assert all(v == "normal" for v in flags(spark, [tuple(r) for r in rows]).values())


def test_constant_source_flags_only_the_spike(spark):
    rows = series(3, hours=500)
    for r in rows:
        r[4] = 57
    rows[77][4] = 34
    got = flags(spark, [tuple(r) for r in rows])
    assert {k for k, v in got.items() if v != "normal"} == {77}


def test_split_source_equals_whole(spark, monkeypatch):
    rows = series(4, hours=24 * 90)
    rows[400][4], rows[401][4], rows[401][5] = 300, 0, 0
    for h in range(900, 900 + 24 * 38):  # longer than a span and its surroundings
        rows[h][6] = rows[899][6]
    for h in range(1900, 1990):
        rows[h][4] = rows[1899][4]
    rows = [tuple(r) for r in rows]
    monkeypatch.setattr(spikes, "SPAN_DAYS", 1000)
    whole = flags(spark, rows)
    for days in (9, 56, 168):
        monkeypatch.setattr(spikes, "SPAN_DAYS", days)
        assert flags(spark, rows) == whole
    stuck = {k for k, v in whole.items() if v.startswith("stuck")}
    assert stuck == {*range(900, 900 + 24 * 38), *range(1900, 1990)} and whole[400] == whole[401] == "spike"


def test_more_readings_change_no_other_source(spark):
    rows = [tuple(r) for r in series(5, hours=600)]
    alone = flags(spark, rows)
    more = flags(spark, rows + [tuple(r) for r in series(6, hours=900, base=10_000)])
    assert {k: v for k, v in more.items() if k < 10_000} == alone


def test_forward_backward_equals_a_plain_run():
    rng, m = np.random.default_rng(0), spikes.transitions(spikes.Model())
    start = np.array([0.95, 0.01, 0.02, 0.01, 0.01])
    for n in (1, 2, 3, 10, 101, 700):
        log_e = rng.normal(0, 4, (n, 5))
        e = np.exp(log_e)
        f, b = np.empty((n, 5)), np.ones((n, 5))
        f[0] = start * e[0]
        for i in range(1, n):
            f[i] = (f[i - 1] @ m) * e[i]
            f[i] /= f[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = m @ (e[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        want = f * b / (f * b).sum(axis=1, keepdims=True)
        assert np.allclose(spikes.forward_backward(log_e, m, start), want)


def test_posteriors_make_the_flags():
    for k in range(5):
        post = np.zeros((4, 5))
        post[:, k] = 1.0
        assert (spikes.states(post) == k).all()


def test_one_value_with_short_runs_aside():
    m = spikes.Model()
    got = spikes.one_value(np.array([5, 7, 7, 90, 91, 7, 7, 8, 7, np.nan, 7]), m)
    assert got.tolist() == [False, False, True, True, True, True, True, False, False, True, True]


def test_nulls_short_sources_and_empty(spark):
    rows = [
        (1, None, T0, "200", 5, 1, "a", None, 0),
        (2, 7, None, "200", 5, 1, "a", None, 0),
        (3, 7, T0, "200", None, None, None, None, 0),
        (None, 7, T0, "200", 5, 1, "a", None, 0),
        (4, 7, T0, None, None, None, None, None, 0),
    ]
    assert flags(spark, rows) == dict.fromkeys([1, 2, 3, 4], "normal")
    assert flags(spark, [rows[0]][:0] or [(9, 1, T0, "304", 0, 0, None, None, 0)]) == {9: "normal"}
    empty = spark.createDataFrame([], SCHEMA)
    assert spikes.flag_readings(empty, "id", "feed_id", "polled_at", "n_items", "n_new", "items_hash", answered()).count() == 0
