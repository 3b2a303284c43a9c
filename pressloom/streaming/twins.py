"""Structured Streaming twins of the batch operators: the same frames, as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(observations: DataFrame, key: str, at: str, late: str = "3 days") -> DataFrame:
    """Each key once, at its first arrival; keys are remembered for ``late``."""
    return observations.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def volumes(articles: DataFrame, at: str, key: str, window: str = "72 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Articles per key in sliding windows of event time."""
    g = articles.withWatermark(at, late).groupBy(F.window(at, window, slide), F.col(key)).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def story_states(sightings: DataFrame, story: str, at: str, dormant_days: int = 4, late: str = "1 day") -> DataFrame:
    """``story_id, status, last_seen``: live when seen, closed after ``dormant_days`` of event time unseen."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"story_id": [key[0]], "status": ["closed"], "last_seen": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else 0
        for pdf in batches:
            last = max(last, int(pdf["at"].max().value // 1000))
        state.update((last,))
        state.setTimeoutTimestamp(last // 1000 + dormant_days * 86_400_000)
        yield pd.DataFrame({"story_id": [key[0]], "status": ["live"], "last_seen": [pd.Timestamp(last, unit="us")]})

    rows = sightings.select(F.col(story).cast("long").alias("story_id"), F.col(at).alias("at")).withWatermark("at", late)
    return rows.groupBy("story_id").applyInPandasWithState(update, "story_id long, status string, last_seen timestamp", "last long", "append", "EventTimeTimeout")
