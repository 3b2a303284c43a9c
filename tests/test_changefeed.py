import random

from pyspark.sql import functions as F

from pressloom.operators import changefeed as cf

SCHEMA = "article_id long, issue_id string, seq long, at long, scored_at long, deleted boolean, keys string, _seq int"


def feed(**kw):
    return cf.Feed(keys=("article_id", "issue_id"), seq="seq", moment=F.coalesce("at", "scored_at"), deleted="deleted", **kw)


def brute(rows):
    best = {}
    for a, i, s, at, sc, d, *_ in rows:
        if s is None:
            continue
        m = at if at is not None else sc
        order = (m is not None, m or 0, s)
        if (a, i) not in best or order > best[(a, i)][0]:
            best[(a, i)] = (order, s, d)
    return {(a, i, s) for (a, i), (_, s, d) in best.items() if not d}


def test_replay_against_brute_force_in_any_order(spark):
    rng = random.Random(3)
    rows = []
    for s in range(1, 400):
        at = rng.choice([None, rng.randrange(50)])
        d = rng.choice([True, False, None, None])
        rows.append((rng.choice([None, 1, 2, 3, 9]), rng.choice([None, "", "x", "y"]), s, at, rng.choice([None, rng.randrange(50)]), d, "k", 1))
    rows += rng.sample(rows, 60)  # repeats
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {tuple(r) for r in cf.replay(df, feed()).collect()}
    assert got == brute(rows)


def test_set_again_after_deletion_and_equal_moments(spark):
    rows = [
        (1, "a", 1, 10, None, None, "", 0),
        (1, "a", 2, 20, None, True, "", 0),
        (1, "a", 3, 30, None, False, "", 0),
        (2, "a", 4, 10, None, None, "", 0),
        (2, "a", 5, 10, None, True, "", 0),  # equal moment, later number
        (3, "a", 6, 5, None, True, "", 0),  # never set
        (4, "a", 7, None, 9, None, "", 0),
    ]
    assert {tuple(r) for r in cf.replay(spark.createDataFrame(rows, SCHEMA), feed()).collect()} == {(1, "a", 3), (4, "a", 7)}


def test_watermark_holds_gaps(spark):
    def mark(numbers, block):
        df = spark.createDataFrame([(n,) for n in numbers], "s long")
        return cf.committed_watermark(df, "s", block=block).first()["watermark"]

    for block in (1, 3, 4, 1 << 16):
        assert mark([3, 1, 2, 5, 6, 2], block) == 3
        assert mark([1, 2, 3, 4, 5, 6, 7, 8], block) == 8
        assert mark([2, 3, 4], block) == 0
        assert mark([9], block) == 0
        assert mark([1, 2, 3, 4, 9], block) == 4
    assert cf.committed_watermark(spark.createDataFrame([], "s long"), "s").first()["watermark"] == 0


def test_open_feed_exposes_only_committed_changes(spark):
    rows = [(1, "a", 1, 1, None, None, "", 0), (2, "a", 2, 2, None, None, "", 0), (1, "a", 4, 9, None, True, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in cf.replay(df, feed(), closed=False).collect()} == {(1, "a", 1), (2, "a", 2)}
    assert {tuple(r) for r in cf.replay(df, feed(), closed=True).collect()} == {(2, "a", 2)}
    status = cf.feed_status(df, feed()).first()
    assert (status["watermark"], status["top"], status["lines"], status["missing"], status["held"]) == (2, 4, 3, 1, 1)


def test_incomplete_transactions_are_held(spark):
    schema = "article_id long, issue_id string, seq long, at long, scored_at long, deleted boolean, txn string, size int"
    rows = [(1, "a", 1, 1, None, None, "t1", 2), (2, "a", 2, 1, None, None, "t1", 2), (3, "a", 3, 1, None, None, "t2", 3), (4, "a", 4, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    f = feed(txn="txn", txn_size="size")
    assert {r["article_id"] for r in cf.replay(df, f).collect()} == {1, 2, 4}
    assert {r["article_id"] for r in cf.replay(df, f, closed=False).collect()} == {1, 2}


def test_empty_feed(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cf.replay(df, feed()).count() == 0


def test_one_number_on_two_keys_loses_no_change(spark):
    rows = [
        (1, "a", 1, 1, None, None, "", 0),
        (2, "b", 1, 2, None, None, "", 0),  # the same number
        (2, "b", 1, 2, None, None, "", 0),
        (3, None, 2, 5, None, None, "", 0),
        (1, "a", 2, 4, None, None, "", 0),
        (4, "a", 4, 3, None, None, "", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in cf.replay(df, feed()).collect()} == brute(rows) == {(1, "a", 2), (2, "b", 1), (3, None, 2), (4, "a", 4)}
    assert {tuple(r) for r in cf.replay(df, feed(), closed=False).collect()} == {(1, "a", 2), (2, "b", 1), (3, None, 2)}
    status = cf.feed_status(df, feed()).first()
    assert (status["watermark"], status["top"], status["lines"], status["missing"], status["held"]) == (2, 4, 3, 1, 1)


def test_closing_applies_held_lines_to_the_committed_state(spark):
    rng = random.Random(11)
    rows = []
    for s in range(1, 300):
        if s not in (120, 121, 200):  # numbers that never come
            rows.append((rng.randrange(12), rng.choice([None, "x"]), s, rng.choice([None, rng.randrange(40)]), rng.randrange(40), rng.choice([True, None]), "k", 1))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {tuple(r) for r in cf.replay(df, feed(), closed=False).collect()} == brute([r for r in rows if r[2] < 120])
    assert {tuple(r) for r in cf.replay(df, feed()).collect()} == brute(rows)


def test_half_a_transaction_holds_what_follows_it(spark):
    schema = "article_id long, issue_id string, seq long, at long, scored_at long, deleted boolean, txn string, size int"
    rows = [(1, "a", 1, 1, None, None, "t1", 1), (2, "a", 2, 1, None, None, "t2", 2), (1, "a", 3, 5, None, True, "t3", 1)]
    f = feed(txn="txn", txn_size="size")
    half = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in cf.replay(half, f, closed=False).collect()} == {(1, "a", 1)}
    assert cf.replay(half, f).count() == 0  # the half is void, the deletion holds
    whole = spark.createDataFrame([*rows, (3, "a", 4, 1, None, None, "t2", 2)], schema)
    assert {tuple(r) for r in cf.replay(whole, f, closed=False).collect()} == {(2, "a", 2), (3, "a", 4)}


def test_the_exposed_state_passes_the_watermark(spark):
    df = spark.createDataFrame([(1, "a", 1, 1, None, None, "", 0)], SCHEMA)
    plan = cf.replay(df, feed())._jdf.queryExecution().executedPlan().toString()
    assert "watermark" in plan
