import random

from pyspark.sql import functions as F

from pressloom.llm import neardup as N

SCHEMA = "id long, title string, standfirst string, rep string, words int"


def pairs(spark, rows, threshold=0.7):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    members, reps = N.near_duplicates(df, "id", N.word_set("title", "standfirst"), threshold)
    return {tuple(r) for r in N.all_pairs(members, reps).collect()}


def brute(rows, threshold=0.7):
    import re

    sets = {}
    for i, t, s, *_ in rows:
        if i is not None:
            sets[i] = frozenset(re.findall("[a-z0-9]+", f"{t or ''} {s or ''}".lower()))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for _ in range(220):
        words = rng.choices(vocab, k=rng.randrange(8, 40))
        for _ in range(rng.randrange(1, 4)):
            w = list(words)
            for _ in range(rng.randrange(0, max(2, len(w) // 6))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, " ".join(w[:6]), " ".join(w[6:]).upper(), "x", 1))
            n += 1
    want = brute(rows)
    got = pairs(spark, rows)
    assert got <= want
    assert len(got) >= 0.99 * len(want) and len(want) > 100


def test_many_copies_cost_one_representative(spark):
    rows = [(k, "the same seven words are here again", None, "", 0) for k in range(60)] + [(100 + k, f"other text number {k} entirely {k * 7}", "", "", 0) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    members, reps = N.near_duplicates(df, "id", N.word_set("title", "standfirst"))
    assert members.select("rep").distinct().count() == 6
    assert {tuple(r) for r in N.all_pairs(members, reps).collect()} == brute(rows)


def test_nulls_empties_repeats_and_long_texts(spark):
    long = " ".join(f"t{k}" for k in range(20_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "  !! ", None, None),
        (3, "alpha beta gamma delta", None, None, None),
        (3, "alpha beta gamma delta", None, None, None),
        (4, "Alpha, BETA gamma", "delta", None, None),
        (None, "alpha beta gamma delta", None, None, None),
        (5, long, "one", None, None),
        (6, long, "two", None, None),
    ]
    assert pairs(spark, rows) == {(3, 4), (5, 6)}
    assert pairs(spark, rows[:0] + [(9, None, None, None, None)]) == set()


def test_pruning_bounds_grow_with_bits():
    bounds = [N.least_matches(0.7, b, 1e-4) for b in (32, 64, 96, 128)]
    assert bounds == sorted(bounds) and bounds[0] > 15 and bounds[-1] < 128 * 0.85
    assert N.least_matches(0.9, 128, 1e-4) > N.least_matches(0.7, 128, 1e-4)


def test_sketch_counts_only_its_own_bits(spark):
    # bit_count extends the sign of an int; the join must not
    df = spark.createDataFrame([(-1, 0)], "a int, b int")
    differ = F.col("a").bitwiseXOR(F.col("b")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    assert df.select(F.bit_count(differ)).first()[0] == 32
