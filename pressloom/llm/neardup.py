"""Near-duplicate records with small edits (problem 2).

Method: Bayesian candidate pruning over MinHash.

1. Records with the same word set are one class; all further work is on one representative each, so
   a record repeated in a third of all rows costs one row.
2. MinHash bands (``BANDS`` bands of ``ROWS`` values) propose pairs. What is shuffled per band is the
   band's key, the representative and a sketch of 128 one-bit MinHash values.
3. Inside the band join the sketch is compared incrementally, 32 bits at a time. After n bits with m
   matches the posterior of the similarity (uniform prior on J, matches binomial with (1 + J) / 2)
   is known; a pair is dropped as soon as P(J >= threshold) falls below ``TOLERANCE``. The least m
   for each n is a constant, so pruning is three integer comparisons in the join condition.
4. Surviving pairs are made distinct and verified exactly on the word sets.

Recall against brute force is set by the bands and the tolerance and is tested. Buckets that grow
hot are split by adaptive skew joins; identical texts, the usual cause, never reach a bucket twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut

THRESHOLD = 0.70
BANDS, ROWS = 30, 5
SKETCH_BITS = 128
TOLERANCE = 1e-4
SEED = 20_260_301


def word_set(title: str, standfirst: str) -> F.Column:
    """Sorted distinct runs of a-z and 0-9 in the lower-cased title, a blank and standfirst."""
    text = F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(standfirst), F.lit(""))))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))))


def least_matches(threshold: float, bits: int, tolerance: float) -> int:
    """Least number of equal bits out of ``bits`` at which P(J >= threshold) >= tolerance."""
    grid = (np.arange(2000) + 0.5) / 2000
    p = (1 + grid) / 2
    for m in range(bits + 1):
        logs = m * np.log(p) + (bits - m) * np.log1p(-p)
        w = np.exp(logs - logs.max())
        if w[grid >= threshold].sum() / w.sum() >= tolerance:
            return m
    return bits


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64)


def minhashes(flat: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """(records, n) MinHash values; ``flat`` word hashes, ``starts`` each record's first word."""
    a, b = _multipliers(n)
    out = np.empty((len(starts), n), np.uint64)
    for k in range(n):
        h = flat * a[k] + b[k]
        h ^= h >> np.uint64(29)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def _signatures(bands: int, rows: int):
    n = bands * rows + SKETCH_BITS
    weights = np.uint64(1) << np.arange(32, dtype=np.uint64)
    schema = pa.schema([("rep", pa.int64()), ("band", pa.int64()), *[(f"s{i}", pa.int32()) for i in range(4)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for off in range(0, big.num_rows, 4096):
                batch = big.slice(off, 4096)
                rep = batch.column(0).to_numpy()
                lists = batch.column(1)
                flat = lists.flatten().to_numpy().astype(np.uint64)
                starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
                if not len(rep):
                    continue
                with np.errstate(over="ignore"):
                    sig = minhashes(_mix(flat), starts, n)
                    bits = (_mix(sig[:, bands * rows :]) & np.uint64(1)).reshape(len(rep), 4, 32)
                    sketch = (bits * weights).sum(axis=2).astype(np.uint32).view(np.int32)
                    keys = np.empty((len(rep), bands), np.int64)
                    for b in range(bands):
                        key = np.full(len(rep), b + 1, np.uint64)
                        for r in range(rows):
                            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
                        keys[:, b] = key.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rep, bands)), pa.array(keys.ravel()), *[pa.array(np.repeat(sketch[:, i], bands)) for i in range(4)]],
                    schema=schema,
                )

    return run


def classes(records: DataFrame, rid: str, words: F.Column) -> DataFrame:
    """``id, rep, words``: each record id with the least id of its word set.

    Repeated rows of one id count once (of differing ones the least word set); null ids and records
    without a word are left out.
    """
    one = records.select(F.col(rid).cast("long").alias("id"), words.alias("words")).filter("id is not null").groupBy("id").agg(F.min("words").alias("words"))
    one = one.filter(F.size("words") > 0).withColumn("key", F.md5(F.concat_ws(" ", "words")))
    reps = one.groupBy("key").agg(F.min("id").alias("rep"))
    return one.join(reps, "key").select("id", "rep", "words")


def candidate_pairs(reps: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE) -> DataFrame:
    """``a, b`` (a < b): representatives that share a band and survive the posterior test."""
    hashed = reps.select("rep", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    sigs = hashed.mapInArrow(_signatures(bands, rows), "rep long, band long, s0 int, s1 int, s2 int, s3 int")
    left = sigs.select("band", F.col("rep").alias("a"), *[F.col(f"s{i}").alias(f"l{i}") for i in range(4)])
    right = sigs.select("band", F.col("rep").alias("b"), *[F.col(f"s{i}").alias(f"r{i}") for i in range(4)])
    equal, tests = F.lit(0), [F.col("a") < F.col("b")]
    for i in range(4):
        differ = F.col(f"l{i}").bitwiseXOR(F.col(f"r{i}")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))  # bit_count would extend the sign
        equal = equal + (F.lit(32) - F.bit_count(differ))
        tests.append(equal >= least_matches(threshold, 32 * (i + 1), tolerance))
    cond = F.col("left.band") == F.col("right.band")
    for t in tests:
        cond = cond & t
    return left.alias("left").join(right.hint("merge").alias("right"), cond).select("a", "b").distinct()


def similar_classes(members: DataFrame, threshold: float = THRESHOLD, **bands: float) -> DataFrame:
    """``a, b, both, either``: pairs of representatives with Jaccard >= threshold, verified exactly."""
    reps = members.filter("id = rep").select("rep", "words")
    pairs = candidate_pairs(reps, threshold, **bands)  # type: ignore[arg-type]
    # word lists compress well on disk: their file size says nothing about their size in memory
    one = pairs.join(reps.select(F.col("rep").alias("a"), F.col("words").alias("wa")).hint("merge"), "a")
    two = one.join(reps.select(F.col("rep").alias("b"), F.col("words").alias("wb")).hint("merge"), "b")
    both = F.size(F.array_intersect("wa", "wb"))
    either = F.size("wa") + F.size("wb") - both
    return two.select("a", "b", both.alias("both"), either.alias("either")).filter(F.col("both") >= F.col("either") * F.lit(threshold) - 1e-9)


def near_duplicates(records: DataFrame, rid: str, words: F.Column, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(membership ``id, rep, words``; pairs of representatives). See the parts for nulls and ties."""
    members = cut(classes(records, rid, words), "words")
    return members, similar_classes(members, threshold)


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b`` (a < b) over all ids: pairs of classes expanded, and the pairs inside each class."""
    m = members.select("id", "rep")
    x, y = m.select(F.col("id").alias("x"), F.col("rep").alias("a")), m.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = pairs.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    within = x.join(y, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
