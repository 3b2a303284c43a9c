import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pressloom.operators import versions
from pressloom.operators.neighbours import following, previous

SCHEMA = "id long, at timestamp, loaded timestamp, x string, _id string, _hash int"
T0 = datetime(2026, 3, 1)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = versions.validity_intervals(df, "id", "at", "loaded", [F.col("x")])
    return {(r["id"], r["valid_from"], r["valid_to"]) for r in out.collect()}


def brute(rows):
    holding = {}
    for i, at, loaded, x, *_ in rows:
        if at is None:
            continue
        key = (loaded is not None, loaded or T0)
        if (i, at) not in holding or key > holding[(i, at)][0]:
            holding[(i, at)] = (key, x)
    out = set()
    for i in {k[0] for k in holding}:
        line = sorted((at, v[1]) for (j, at), v in holding.items() if j == i)
        starts = [at for k, (at, x) in enumerate(line) if k == 0 or line[k - 1][1] != x]
        out |= {(i, s, e) for s, e in zip(starts, [*starts[1:], None], strict=True)}
    return out


def test_against_brute_force_with_gaps_late_lines_and_long_histories(spark):
    rng = random.Random(4)
    rows = []
    for i in (None, 1, 2, 3):
        for k in range(400):
            if rng.random() < 0.25:
                continue  # an export without a line
            at = T0 + timedelta(hours=2 * k)
            for _ in range(rng.choice([1, 1, 2])):
                rows.append((i, at, at + timedelta(minutes=rng.randrange(10**6)), rng.choice(["a", "a", "a", "b", None]), "clash", 7))
    rows += rng.sample(rows, 100)
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_null_moments_and_empty(spark):
    assert run(spark, [(1, None, T0, "a", "", 0)]) == set()
    assert run(spark, [(1, T0, None, "a", "", 0), (1, T0, T0, "b", "", 0)]) == {(1, T0, None)}
    assert versions.validity_intervals(spark.createDataFrame([], SCHEMA), "id", "at", "loaded", [F.col("x")]).count() == 0


def test_more_than_64_snapshots_a_day(spark):
    rows = [(1, T0 + timedelta(minutes=k), T0, "a" if k // 70 % 2 == 0 else "b", "", 0) for k in range(300)]
    assert run(spark, rows) == brute(rows)


def test_neighbours_over_blocks(spark):
    rows = [(k % 2, k // 10, k) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, b int, v int")
    got = {(r["v"], r["p"]["v"] if r["p"] else None, r["n"]["v"] if r["n"] else None) for r in following(previous(df, ["k"], "b", [F.col("v")], F.col("v"), "p"), ["k"], "b", [F.col("v")], F.col("v"), "n").collect()}
    assert got == {(v, v - 2 if v >= 2 else None, v + 2 if v < 58 else None) for v in range(60)}


def test_squeeze(spark):
    df = spark.createDataFrame([(" a\t b  ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(versions.squeeze(F.col("t"))).collect()] == ["a b", None, ""]
