"""Filling fixed-capacity containers with items (problem 7).

Method: Martello-Toth dominance reduction, then best fit.

Sizes are whole numbers up to the capacity, so an instance is a histogram of at most ``capacity``
counts, whatever the number of documents. Reduction and best fit work on that histogram and produce
groups of equal containers. What leaves the executors is the histogram, what returns is a table of
rank ranges per size; documents learn their container from their rank among the documents of their
size. The rank is two-level (size, slice), so a size held by a third of all documents does not end
up in one task.

Reduction, from the greatest size a downwards: a set F with a dominates every other set with a if the
others' parts can be exchanged for greater items of F. Fixed permanently, in bulk, are
- a alone, if nothing fits beside it;
- a with k, if k fills the container, or k is the greatest that fits and no two others fit beside a,
  or no two that fit sum to more than k;
- a with s and t, if no three fit beside a, s is the greatest that fits with any second, and t the
  greatest that fits beside both and no pair offers a greater second.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.session import cut

CAPACITY = 2048
#: Where the public tokenizer's vocabulary lies, its file, and its splitting pattern's module.
VOCABULARY_DIR, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Slices of each size for ranking.
SLICES = 256


@lru_cache(maxsize=2)
def _encoder(directory: str, name: str):  # noqa: ANN202
    import tiktoken

    with open(os.path.join(directory, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # the splitting pattern of the public byte-level vocabulary (a fixed value)
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, did: str, text: str, directory: str = VOCABULARY_DIR, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, tokens``: length of each whole text in tokens of a public tokenizer; null text is 0.

    Repeated ids count once (of differing rows the longest); null ids are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(directory, name)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    rows = docs.filter(F.col(did).isNotNull()).select(F.col(did).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id long, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


@dataclass
class Plan:
    """Groups of equal containers: sizes in each, and how many there are."""

    groups: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    @property
    def containers(self) -> int:
        return sum(m for _, m in self.groups)


class _Sizes:
    """Counts of remaining items with quick neighbours in the set of sizes present."""

    def __init__(self, count: np.ndarray):
        self.count = count.astype(np.int64).copy()

    def at_most(self, x: int, spare: dict[int, int] | None = None) -> int:
        """Greatest present size <= x when ``spare`` items are in use; 0 if none."""
        x = min(x, len(self.count) - 1)
        while x > 0:
            seg = self.count[max(0, x - 255) : x + 1]
            hits = np.flatnonzero(seg)
            if not len(hits):
                x -= len(seg)
                continue
            x = max(0, x - 255) + int(hits[-1]) if x >= 255 else int(hits[-1])
            if x == 0 or self.count[x] > (spare or {}).get(x, 0):
                return x
            x -= 1
        return 0

    def least(self, k: int, spare: dict[int, int]) -> list[int]:
        """The k least remaining items, ``spare`` in use; fewer if there are fewer."""
        out: list[int] = []
        for s in np.flatnonzero(self.count[1:]) + 1:
            free = int(self.count[s]) - spare.get(int(s), 0)
            out += [int(s)] * max(0, min(k - len(out), free))
            if len(out) >= k:
                break
        return out


def _best_pair_sum(sizes: _Sizes, room: int, spare: dict[int, int]) -> int:
    """Greatest sum <= room of two remaining items, 0 if no two fit."""
    best = 0
    x = sizes.at_most(room - 1, spare)
    while x > 0 and 2 * x > best:
        rest = min(room - x, x)
        y = sizes.at_most(rest, {**spare, x: spare.get(x, 0) + 1})
        if y:
            best = max(best, x + y)
            if best == room:
                break
        x = sizes.at_most(x - 1, spare)
    return best


def _uses(items: tuple[int, ...]) -> dict[int, int]:
    out: dict[int, int] = {}
    for s in items:
        out[s] = out.get(s, 0) + 1
    return out


def dominating_set(sizes: _Sizes, a: int, capacity: int) -> tuple[int, ...] | None:
    """A set with ``a`` that dominates all others with ``a``, or None if none is proved."""
    room, spare = capacity - a, {a: 1}
    k = sizes.at_most(room, spare)
    if k == 0:
        return (a,)
    if k == room:
        return (a, k)
    low = sizes.least(3, spare)
    if len(low) < 2 or low[0] + low[1] > room:
        return (a, k)
    if _best_pair_sum(sizes, room, spare) <= k and (len(low) < 3 or sum(low) > room):
        return (a, k)
    if len(low) < 3 or sum(low) > room:
        s = sizes.at_most(room - low[0], spare)
        if s == k:
            t = sizes.at_most(room - s, {a: 1, s: 1 + (s == a)})
            # the greatest second that any pair x >= y can have
            y = sizes.at_most(room // 2, spare)
            if t >= y and t > 0:
                return (a, s, t)
    return None


def reduce_instance(sizes: _Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets in bulk and removes them from ``sizes``."""
    fixed = []
    a = sizes.at_most(capacity)
    while a > 0:
        found = dominating_set(sizes, a, capacity)
        if found is None:
            a = sizes.at_most(a - 1)
            continue
        # what is left only shrinks, so the set stays dominating while its items last
        uses = _uses(found)
        times = min(int(sizes.count[s]) // n for s, n in uses.items())
        for s, n in uses.items():
            sizes.count[s] -= n * times
        fixed.append((found, times))
        a = sizes.at_most(a)
    return fixed


def best_fit(sizes: _Sizes, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over the histogram; equal containers are filled together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    have = np.zeros(capacity + 1, bool)
    for s in range(len(sizes.count) - 1, 0, -1):
        n = int(sizes.count[s])
        while n > 0:
            fits = np.flatnonzero(have[s:])
            if not len(fits):
                per = capacity // s
                full, rest = divmod(n, per)
                for items, many in (((s,) * per, full), ((s,) * rest, 1 if rest else 0)):
                    if many:
                        left = capacity - s * len(items)
                        open_.setdefault(left, []).append((items, many))
                        have[left] = True
                n = 0
                continue
            room = s + int(fits[0])
            items, many = open_[room].pop()
            # a container stays the best fit for this size while it has room
            per = min(room // s, n)
            take = min(many, n // per)
            if many > take:
                open_[room].append((items, many - take))
            if not open_[room]:
                have[room] = False
            left = room - s * per
            open_.setdefault(left, []).append((items + (s,) * per, take))
            have[left] = True
            n -= per * take
        sizes.count[s] = 0
    return [g for groups in open_.values() for g in groups]


def solve(count: np.ndarray, capacity: int) -> Plan:
    """``count[s]``: items of size s, 1 <= s <= capacity -> containers for all of them."""
    sizes = _Sizes(count)
    fixed = reduce_instance(sizes, capacity)
    return Plan(fixed + best_fit(sizes, capacity))


def rank_ranges(plan: Plan, capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size: first rank, first container and copies per container of each group that uses it."""
    used = np.zeros(capacity + 1, np.int64)
    rows: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for items, many in plan.groups:
        for s, n in sorted(_uses(items).items()):
            rows.setdefault(s, []).append((int(used[s]), base, n))
            used[s] += n * many
        base += many
    return {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}  # type: ignore[misc]


def _pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, piece, size``: a document beyond the capacity is cut into full pieces and a rest."""
    last = F.greatest(F.ceil(F.col("tokens") / capacity).cast("long") - 1, F.lit(0))
    cut_up = sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return cut_up.select("doc_id", "piece", F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size"))


def pack(spark: SparkSession, sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, size, container``; containers are numbered from 0.

    ``sized``: ``doc_id, tokens``. An item is cut only if it exceeds the capacity. Items of size 0
    take no room and go into container 0. Equal sizes are told apart by slice and id, so the result
    does not depend on the order of rows. Empty input gives no rows.
    """
    pieces = cut(_pieces(sized, capacity).withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)).cast("int")), "pieces")
    per = pieces.filter("size > 0").groupBy("size", "slice").agg(F.count("*").alias("n"))
    table = per.toPandas()  # at most capacity x SLICES rows
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, table["size"].to_numpy(np.int64), table["n"].to_numpy(np.int64))
    ranges = rank_ranges(solve(count, capacity), capacity)
    table = table.sort_values(["size", "slice"])
    table["start"] = table.groupby("size")["n"].cumsum() - table["n"]
    starts = {(int(s), int(c)): int(x) for s, c, x in zip(table["size"], table["slice"], table["start"], strict=True)}
    shared = spark.sparkContext.broadcast((ranges, starts))
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("size", "slice").orderBy("doc_id", "piece")) - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_size, first = shared.value
        for pdf in batches:
            container = np.zeros(len(pdf), np.int64)
            offset = np.array([first.get((int(s), int(c)), 0) for s, c in zip(pdf["size"], pdf["slice"], strict=True)], np.int64)
            rank = pdf["r"].to_numpy(np.int64) + offset
            size = pdf["size"].to_numpy()
            for s in np.unique(size):
                if s == 0:
                    continue
                at = np.flatnonzero(size == s)
                begin, base, copies = by_size[int(s)]
                g = np.searchsorted(begin, rank[at], "right") - 1
                container[at] = base[g] + (rank[at] - begin[g]) // copies[g]
            yield pdf[["doc_id", "piece", "size"]].assign(container=container)

    return ranked.select("doc_id", "piece", "size", "slice", "r").mapInPandas(place, "doc_id long, piece long, size int, container long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers, and the share left empty."""
    per = packed.groupBy("container").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
    out = per.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("n").alias("pieces"))
    return out.select("*", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("empty"))
