"""Statistics that say whether scores can be trusted: agreement, calibration, direction, switching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
SCALE = (-2, -1, 0, 1, 2)
MIN_GROUP, SPREAD_LIMIT = 20, 0.25
DEADBAND, MIN_SIDE, LEANING_CUT = 0.15, 4, 0.15


def labels_side_by_side(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Items both labellers saw: keys, ``a``, ``b`` (null = abstained). Keys match null-safely."""
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("score").alias("b"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.select(*keys, F.col("score").alias("a")).join(right, cond).select(*keys, "a", "b")


def _both(items: DataFrame) -> DataFrame:
    return items.filter("a is not null and b is not null")


def same_sign(a: Column, b: Column) -> Column:
    return F.signum(a) == F.signum(b)


# fixed values: below each bound a kappa says so much of the instructions the labellers had
KAPPA_BANDS = ((0.4, "ambiguous"), (0.6, "usable"), (0.8, "good"))


def kappa_band(kappa: Column) -> Column:
    """What a kappa says; ``doubtful`` from the last bound on (labellers may have conferred), null of null."""
    band = F.when(kappa.isNull(), F.lit(None))
    for bound, name in KAPPA_BANDS:
        band = band.when(kappa < bound, name)
    return band.otherwise("doubtful")


def weighted_kappa(items: DataFrame, scale: tuple[int, ...] = SCALE) -> DataFrame:
    """One row ``n, kappa``: 1 - sum(w O) / sum(w E), w the squared distance on the scale.

    Without a pair kappa is null; without expected disagreement it is 1 if there is none, else 0.
    The expected part needs only the two marginals, which have as many rows as the scale.
    """
    k = float(len(scale) - 1)
    cells = _both(items).groupBy("a", "b").agg(F.count("*").alias("c"))
    ma = cells.groupBy("a").agg(F.sum("c").alias("na"))
    mb = cells.groupBy("b").agg(F.sum("c").alias("nb"))

    def w(x: Column, y: Column) -> Column:
        return F.pow((x - y) / k, 2)

    seen = cells.agg(F.sum("c").alias("n"), F.sum(w(F.col("a"), F.col("b")) * F.col("c")).alias("num"))
    chance = ma.join(mb, F.lit(True)).agg(F.sum(w(F.col("a"), F.col("b")) * F.col("na") * F.col("nb")).alias("den"))  # scale x scale rows
    both = seen.join(chance, F.lit(True)).withColumn("den", F.col("den") / F.col("n"))
    kappa = F.when(F.col("n").isNull(), None).when(F.col("den") == 0, F.when(F.col("num") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("num") / F.col("den"))
    return both.select(F.coalesce("n", F.lit(0)).alias("n"), kappa.alias("kappa"))


def agreement(items: DataFrame) -> DataFrame:
    """One row: items, compared, shares exact / within one / of one sign, and who abstained."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    gap = F.abs(F.col("a") - F.col("b"))

    def share(c: Column) -> Column:
        return F.avg(F.when(both, c.cast("int")))

    return items.agg(
        F.count("*").alias("n_items"),
        F.count_if(both).alias("n_compared"),
        share(gap == 0).alias("exact"),
        share(gap <= 1).alias("within_1"),
        share(same_sign(F.col("a"), F.col("b"))).alias("same_sign"),
        F.count_if(F.col("a").isNull() & F.col("b").isNull()).alias("both_abstained"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("only_a_scored"),
        F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("only_b_scored"),
    )


def worst(items: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The ``n`` greatest disagreements, ties in order of the keys (a top-n report)."""
    gap = F.abs(F.col("a") - F.col("b"))
    return _both(items).withColumn("gap", gap).filter("gap > 0").orderBy(F.desc("gap"), *[F.asc_nulls_first(k) for k in keys]).limit(n)


def error_statistics(model: Column, gold: Column) -> list[Column]:
    e = model - gold
    return [
        F.count("*").alias("n"),
        F.avg(e).alias("bias"),
        F.avg(F.abs(e)).alias("mae"),
        F.stddev_pop(e).alias("sd"),
        F.avg((F.abs(e) <= 1).cast("int")).alias("within_1"),
        F.avg(same_sign(model, gold).cast("int")).alias("same_sign"),
    ]


def calibrate(items: DataFrame, group: str) -> DataFrame:
    """Per group: n, bias, mae, sd, within_1, same_sign of ``a`` (model) against ``b`` (gold)."""
    return _both(items).groupBy(F.coalesce(F.col(group).cast("string"), F.lit("_none")).alias("grp")).agg(*error_statistics(F.col("a"), F.col("b")))


def skew(groups: DataFrame, least: int = MIN_GROUP, limit: float = SPREAD_LIMIT) -> DataFrame:
    """One row over groups of at least ``least``: spread of bias, its ends, and whether one offset will do.

    With fewer than two such groups nothing but their number is said.
    """
    g = groups.filter(F.col("n") >= least).agg(
        F.count("*").alias("groups_measured"), (F.max("bias") - F.min("bias")).alias("spread"),
        F.min(F.struct("bias", "grp")).alias("lo"), F.max(F.struct("bias", F.col("grp").alias("g"))).alias("hi"), F.avg("bias").alias("mean_offset"),
    )
    enough = F.col("groups_measured") >= 2
    return g.select(
        "groups_measured",
        F.when(enough, F.col("spread")).alias("spread"),
        F.when(enough, F.col("lo.grp")).alias("worst_low"),
        F.when(enough, F.col("hi.g")).alias("worst_high"),
        F.when(enough, F.col("mean_offset")).alias("mean_offset"),
        F.when(enough, F.col("spread") < limit).alias("constant_enough"),
    )


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than three pairs or no variance."""
    ok = x.isNotNull() & y.isNotNull()
    return F.when((F.count_if(ok) >= 3) & (F.stddev_pop(F.when(ok, x)) > 0) & (F.stddev_pop(F.when(ok, y)) > 0), F.corr(x, y))


def by_outlet(items: DataFrame) -> DataFrame:
    """Each outlet's mean under both labellers, over the items both scored."""
    return _both(items).groupBy("outlet_id").agg(F.avg("a").alias("before"), F.avg("b").alias("after"), F.count("*").alias("n"))


def switch_verdict(kappa: DataFrame, summary: DataFrame, outlets: DataFrame) -> DataFrame:
    """One row: kappa, same_sign, correlation of outlets' means, and the verdict."""
    corr = outlets.agg(pearson(F.col("before"), F.col("after")).alias("corr"))
    row = kappa.select("kappa").join(summary.select("same_sign"), F.lit(True)).join(corr, F.lit(True))  # one row each
    k, s, c = (F.coalesce(x, F.lit(0.0)) for x in ("kappa", "same_sign", "corr"))
    verdict = F.when((k >= 0.6) & (s >= 0.85) & (c >= 0.8), "CLOSE ENOUGH").when((k >= 0.4) & (c >= 0.6), "WITH CARE").otherwise("NOT GOOD ENOUGH")
    return row.withColumn("verdict", verdict)


def referee(items: DataFrame, key: DataFrame, keys: list[str]) -> DataFrame:
    """One row: answers of ``a`` on the key's items that are right, backwards, neutral or missing."""
    right = key.select(*[F.col(k).alias(f"_{k}") for k in keys], "direction")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    j = right.join(items, cond, "left").withColumn("s", F.signum("a"))
    hit, back = F.col("s") == F.col("direction"), F.col("s") == -F.col("direction")
    return j.agg(
        F.count_if(hit).alias("correct"), F.count_if(back & ~hit).alias("backwards"),
        F.count_if(F.col("s").isNotNull() & ~hit & ~back).alias("neutral"), F.count_if(F.col("s").isNull()).alias("missing"),
    )


def consensus(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Rounded mean over labellers, halves to the even number; null where all abstained."""
    return labels.groupBy(*keys).agg(F.bround(F.avg("score"), 0).cast("int").alias("score"), F.count("score").alias("labellers"))


def direction(scores: DataFrame, outlets: DataFrame, expected: DataFrame) -> DataFrame:
    """``issue_id, want, n_left, n_right, diff, verdict``: does the score run the way it must?

    ``expected``: ``issue_id, want`` (sign of left minus right, 0 asserts nothing).
    """
    side = F.when(F.col("leaning") < -LEANING_CUT, "left").when(F.col("leaning") > LEANING_CUT, "right")
    told = scores.filter("stance is not null").join(outlets.select(F.col("id").alias("outlet_id"), side.alias("side")), "outlet_id", "left")
    left, right = F.when(F.col("side") == "left", F.col("stance")), F.when(F.col("side") == "right", F.col("stance"))
    sums = told.groupBy("issue_id").agg(F.count(left).alias("nl"), F.count(right).alias("nr"), F.avg(left).alias("ml"), F.avg(right).alias("mr"))
    j = expected.join(sums, "issue_id", "left").withColumn("nl", F.coalesce("nl", F.lit(0))).withColumn("nr", F.coalesce("nr", F.lit(0)))
    diff = F.col("ml") - F.col("mr")
    enough = (F.col("nl") >= MIN_SIDE) & (F.col("nr") >= MIN_SIDE)
    verdict = (
        F.when(F.col("want") == 0, "NO ASSERTION").when(~enough, "TOO FEW").when(F.abs(diff) < DEADBAND, "INCONCLUSIVE")
        .when(F.signum(diff) == F.col("want"), "ok").otherwise("INVERTED")
    )
    return j.select("issue_id", "want", F.col("nl").alias("n_left"), F.col("nr").alias("n_right"), F.when(enough & (F.col("want") != 0), diff).alias("diff"), verdict.alias("verdict"))
