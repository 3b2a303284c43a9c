"""Applying a stream of inserts, updates and deletes (problem 6).

Method: commit-ordered transactional replay.

1. Repeats of a line are the same change: lines are identified by sequence number and keys.
2. Lines are assembled into transactions. A transaction is complete when it has as many distinct
   lines as it announces; incomplete ones are held with everything that would overtake them.
3. The committed watermark is the highest sequence number below which no number is missing. It is
   found by counting distinct numbers per block of ``BLOCK`` consecutive numbers (an aggregate with
   a map-side half); only the first incomplete block, at most ``BLOCK`` numbers, is looked into.
4. Keys do not conflict with each other, so they are replayed in parallel: the holding change of a
   key is one ``max_by`` over (moment, sequence number), combined map-side, so a hot key costs one
   row per task in the shuffle.
5. State is exposed only through the watermark: the committed state is the replay of the changes at
   or below it. Closing the feed (``closed=True``) declares the numbers still missing void and applies
   what was held to the committed state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.session import cut

#: Consecutive sequence numbers counted together.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Feed:
    """Which columns of a change feed mean what.

    ``keys``: the row a change is about; null is a key value of its own. ``seq``: number given when
    the line was written. ``moment``: when the change took effect, a column expression. ``deleted``:
    boolean column, null means a plain set. ``txn``/``txn_size``: transaction and how many lines it
    announces; without them every line is its own transaction.
    """

    keys: tuple[str, ...]
    seq: str
    moment: Column
    deleted: str
    txn: str | None = None
    txn_size: str | None = None


def distinct_lines(lines: DataFrame, feed: Feed) -> DataFrame:
    """One row per different line: sequence number, keys and the feed's control columns.

    Lines that share a number but not their keys are all kept; of one number and keys the greatest
    moment counts. Lines without a number have no place in the commit order and are left out.
    """
    packed = lines.select(
        F.col(feed.seq).alias("_seq"),
        feed.moment.alias("_moment"),
        F.coalesce(F.col(feed.deleted), F.lit(False)).alias("_deleted"),
        *([F.col(feed.txn).alias("_txn")] if feed.txn else []),
        *([F.col(feed.txn_size).alias("_size")] if feed.txn_size else []),
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(feed.keys)],
    )
    keys = [f"_k{i}" for i in range(len(feed.keys))]
    rest = [c for c in packed.columns if c not in ("_seq", *keys)]
    # of lines equal in number and keys the latest is the one that can hold
    numbered = packed.filter("_seq is not null").groupBy("_seq", *keys).agg(F.max(F.struct(*rest)).alias("r"))
    return numbered.select("_seq", *keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def committed_watermark(numbers: DataFrame, seq: str, start: int = 1, block: int = BLOCK) -> DataFrame:
    """One row ``watermark``: the highest number w with all of start..w present, or start - 1."""
    n = numbers.select(F.col(seq).cast("long").alias("s")).filter(F.col("s") >= start).distinct()
    blocks = n.groupBy(F.floor((F.col("s") - start) / block).alias("b")).agg(F.count("*").alias("n"), F.max("s").alias("top"))
    following = blocks.select((F.col("b") - 1).alias("b"), F.lit(1).alias("next"))
    # the first block that is not full, or has no successor, holds the watermark
    edge = blocks.join(following, "b", "left").filter((F.col("n") < block) | F.col("next").isNull()).agg(F.min("b").alias("b"))
    whole = blocks.agg(F.min("b").alias("least"))
    edge = edge.crossJoin(whole).select(F.when(F.col("least") == 0, F.col("b")).alias("b"))  # one row each
    inside = n.withColumn("b", F.floor((F.col("s") - start) / block)).join(F.broadcast(edge.filter("b is not null")), "b", "left_semi")
    # in one block: the watermark is the number whose rank in the block still equals its offset
    ranked = inside.groupBy("b").agg(F.array_sort(F.collect_list("s")).alias("all"))
    found = ranked.select(
        F.aggregate(
            "all",
            (F.lit(start) + F.col("b") * block - 1).cast("long"),
            lambda acc, s: F.when(s == acc + 1, s).otherwise(acc),
        ).alias("w")
    )
    # a block that misses its first number leaves the end of the block before it
    return found.agg(F.coalesce(F.max("w"), F.lit(start - 1)).cast("long").alias("watermark"))


def hold_incomplete(lines: DataFrame) -> DataFrame:
    """The lines of complete transactions; ``_txn`` null is a transaction of its own."""
    if "_txn" not in lines.columns:
        return lines
    return lines.join(_incomplete(lines), "_txn", "left_anti")


def _incomplete(lines: DataFrame) -> DataFrame:
    have = lines.filter("_txn is not null").groupBy("_txn").agg(F.count("*").alias("_have"), F.max("_size").alias("_want"))
    return have.filter("_have < coalesce(_want, 1)").select("_txn")


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the holding change, deletions included: ``_moment, _seq, _deleted``."""
    order = F.struct(F.col("_moment").isNotNull(), "_moment", "_seq")
    held = rows.groupBy(*keys).agg(F.max(F.struct(order.alias("o"), F.col("_moment").alias("m"), F.col("_seq").alias("s"), F.col("_deleted").alias("d"))).alias("h"))
    return held.select(*keys, F.col("h.m").alias("_moment"), F.col("h.s").alias("_seq"), F.col("h.d").alias("_deleted"))


def replay(lines: DataFrame, feed: Feed, closed: bool = True, start: int = 1) -> DataFrame:
    """The state a change feed leads to: the feed's keys and ``seq`` of the holding change.

    Of one key the change with the latest moment holds (a missing moment is earlier than any), the
    highest number among equal moments. A key whose holding change deletes it has no row, whether it
    was ever set or not; a later set brings it back. Repeated lines count once, order does not
    matter. Empty input gives no rows.

    ``closed=False`` exposes only what is committed: changes at or below the contiguous watermark
    and, with transactions, only numbers before the first incomplete one. ``closed=True`` takes that
    committed state and then closes the feed: numbers still missing and transactions still incomplete
    become void, and the held lines are applied to the committed state.
    """
    keys = [f"_k{i}" for i in range(len(feed.keys))]
    # the watermark and the replay read the same lines: they are reduced once
    rows = cut(distinct_lines(lines, feed), "feed")
    mark = committed_watermark(rows, "_seq", start)
    if "_txn" in rows.columns:
        held = rows.join(_incomplete(rows), "_txn", "left_semi").agg((F.min("_seq") - 1).alias("held"))
        mark = mark.crossJoin(held).select(F.least("watermark", "held").alias("watermark"))  # one row each
    mark = cut(mark, "watermark")  # one number, read by both sides below
    committed = _latest(rows.join(F.broadcast(mark), F.col("_seq") <= F.col("watermark")), keys)
    if closed:
        late = hold_incomplete(rows).join(F.broadcast(mark), F.col("_seq") > F.col("watermark"))
        committed = _latest(committed.unionByName(_latest(late, keys)), keys)
    return committed.filter("not _deleted").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(feed.keys)], F.col("_seq").alias(feed.seq))


def feed_status(lines: DataFrame, feed: Feed, start: int = 1) -> DataFrame:
    """One row ``watermark, top, lines, missing, held``: how far the feed is committed."""
    rows = distinct_lines(lines, feed).select("_seq").distinct()
    mark = committed_watermark(rows, "_seq", start)
    return (
        rows.crossJoin(F.broadcast(mark))  # a single row
        .groupBy("watermark")
        .agg(F.max("_seq").alias("top"), F.count("*").alias("lines"), F.count_if(F.col("_seq") > F.col("watermark")).alias("held"))
        .select("watermark", "top", "lines", (F.col("top") - F.lit(start - 1) - F.col("lines")).alias("missing"), "held")
    )
