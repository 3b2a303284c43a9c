"""History of changing entity attributes (problem 4).

Method: presence bitmaps. Snapshots are numbered by (UTC day, rank within the day / 64, bit). For
each entity and hash of its compared attributes one bit per snapshot is set with a ``bit_or``
aggregate (map-side combined), giving one 64-bit word per entity, hash and word. Runs of
consecutive bits are then read from the words: a bit starts a version where the entity's previous
set bit, in whatever word, belongs to another hash. A snapshot without a line sets no bit at all,
so a gap neither ends nor starts a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.operators.neighbours import following, previous

BITS = 64
#: Days per block of the previous/next lookups.
BLOCK_DAYS = 32


def squeeze(text: Column) -> Column:
    """Without blanks and tabs around, repeated ones (of any script) as one blank."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def snapshot_words(moments: DataFrame, at: str) -> DataFrame:
    """Distinct moments -> ``_at, _day, _word, _bit``, in order of time.

    The rank is taken within a day, so days are numbered in parallel.
    """
    days = moments.select(F.col(at).alias("_at")).filter(F.col("_at").isNotNull()).distinct().withColumn("_day", F.unix_date(F.to_date("_at")))
    rank = F.row_number().over(Window.partitionBy("_day").orderBy("_at")) - 1
    return days.withColumn("_rank", rank).select("_at", "_day", F.floor(F.col("_rank") / BITS).cast("int").alias("_word"), (F.col("_rank") % BITS).cast("int").alias("_bit"))


def presence_bitmaps(lines: DataFrame, words: DataFrame) -> DataFrame:
    """``_id, _at, _hash`` -> ``_id, _day, _word, _hash, _bits``, one bit per snapshot."""
    placed = lines.join(words, "_at")
    return placed.groupBy("_id", "_day", "_word", "_hash").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))


def run_starts(bitmaps: DataFrame) -> DataFrame:
    """Bits that open a run -> ``_id, _day, _word, _bit``.

    A word holds at most 64 hashes, so a group of one (entity, word) is bounded.
    """
    per_word = bitmaps.groupBy("_id", "_day", "_word").agg(F.collect_list(F.struct("_hash", "_bits")).alias("maps"))
    # the hash of each set bit, in order of the bits
    ordered = F.expr(
        "filter(transform(sequence(0, 63), p -> named_struct('bit', p, 'hash', "
        "get(transform(filter(maps, m -> getbit(m._bits, p) = 1), m -> m._hash), 0))), x -> x.hash is not null)"
    )
    per_word = per_word.withColumn("seq", ordered).drop("maps").withColumn("_block", F.floor(F.col("_day") / BLOCK_DAYS))
    linked = previous(per_word, ["_id"], "_block", [F.col("_day"), F.col("_word")], F.element_at("seq", -1)["hash"], "before")
    starts = F.expr(
        "filter(transform(seq, (x, i) -> if(if(i = 0, before.v, seq[greatest(i - 1, 0)].hash) <=> x.hash, null, x.bit)), b -> b is not null)"
    )
    return linked.select("_id", "_day", "_word", F.explode(starts).alias("_bit"))


def validity_intervals(lines: DataFrame, entity: str, at: str, loaded: str, attributes: list[Column]) -> DataFrame:
    """Periods of each version of each entity: ``<entity>, valid_from, valid_to`` (timestamps).

    Of the lines of one entity and moment the one loaded last holds (a missing load time is earliest;
    among equal ones the greatest attribute hash). Versions follow each other in order of ``at``;
    the last has a null ``valid_to``. Lines without a moment describe nothing and are left out; a
    null entity is an entity of its own. Repeated rows count once; empty input gives no rows.
    """
    digest = F.md5(F.to_json(F.struct(*[a.alias(f"a{i}") for i, a in enumerate(attributes)]), {"ignoreNullFields": "false"}))
    told = lines.select(F.col(entity).alias("_id"), F.col(at).alias("_at"), F.col(loaded).alias("_loaded"), digest.alias("_hash")).filter(F.col("_at").isNotNull())
    last = F.max(F.struct(F.col("_loaded").isNotNull(), "_loaded", "_hash"))
    holding = told.groupBy("_id", "_at").agg(last.alias("h")).select("_id", "_at", F.col("h._hash").alias("_hash"))
    words = snapshot_words(lines, at)
    starts = run_starts(presence_bitmaps(holding, words)).join(words, ["_day", "_word", "_bit"])
    starts = starts.select("_id", "_at", F.floor(F.col("_day") / BLOCK_DAYS).alias("_block"))
    linked = following(starts, ["_id"], "_block", [F.col("_at")], F.col("_at"), "after")
    return linked.select(F.col("_id").alias(entity), F.col("_at").alias("valid_from"), F.col("after.v").alias("valid_to"))
