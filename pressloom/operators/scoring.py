"""Scoring work lists by an external model: what is missing, groups, retries by halves, a fake model.

The model is a callable from a list of items to answers; it runs in ``mapInPandas`` over packed groups,
so a real one is a plug-in and tests use :func:`fake_scorer`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = 20
MAX_DEPTH = 6
Scorer = Callable[[list[dict]], dict[int, float | None]]


class RequestRefused(Exception):
    """The model would not answer this request; smaller ones may pass."""


class QuotaReached(Exception):
    """No further request will be answered in this run."""


def missing(work: DataFrame, scores: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows of ``work`` without a score under the same keys (null-safe), of the rubric version if given."""
    s = scores.filter(F.col("rubric_version") == version) if version else scores
    s = s.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return work.join(s, cond, "left_anti")


def packed(work: DataFrame, target: str, rid: str, size: int = GROUP) -> DataFrame:
    """``target, pack, items``: one target per group, at most ``size`` items in order of id."""
    rank = F.row_number().over(Window.partitionBy(target).orderBy(rid)) - 1
    rows = work.withColumn("pack", F.floor(rank / size).cast("int"))
    return rows.groupBy(target, "pack").agg(F.to_json(F.array_sort(F.collect_list(F.struct(rid, *[c for c in work.columns if c not in (rid, target)])))).alias("items"))


def answers(scorer: Scorer, items: list[dict], rid: str, depth: int = 0) -> dict[int, float | None]:
    """Answers to a group; unanswered items and refused groups are asked again in halves."""
    try:
        got = dict(scorer(items))
    except RequestRefused:
        got = {}
        if len(items) == 1:
            return {}
    left = [i for i in items if i[rid] not in got]
    if not left or depth >= MAX_DEPTH or (len(left) == len(items) == 1):
        return got
    half = (len(left) + 1) // 2
    for part in (left[:half], left[half:]):
        if part:
            got.update(answers(scorer, part, rid, depth + 1))
    return got


def score(groups: DataFrame, scorer: Scorer, rid: str = "id") -> DataFrame:
    """``id, score`` for the groups of :func:`packed`; a reached quota ends the partition's run."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[int, float | None] = {}
            for text in pdf["items"]:
                try:
                    out.update(answers(scorer, json.loads(text), rid))
                except QuotaReached:
                    yield pd.DataFrame({"id": list(out), "score": pd.array(list(out.values()), dtype="Float64")})
                    return
            yield pd.DataFrame({"id": list(out), "score": pd.array(list(out.values()), dtype="Float64")})

    return groups.select("items").mapInPandas(run, "id long, score double")


def fake_scorer(items: list[dict]) -> dict[int, float | None]:
    """Deterministic: the length of the title decides; an empty title abstains."""
    return {i["id"]: (float(len(i.get("title") or "") % 5 - 2) if i.get("title") else None) for i in items}


def costs(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """One row ``tokens_in, tokens_out, cost`` from calls with both counts; prices are per million tokens."""
    g = calls.agg(F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))
    return g.withColumn("cost", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6)
