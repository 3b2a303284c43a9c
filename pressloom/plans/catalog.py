"""All queries and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressloom.plans import core_problems, reference, reference_sql, worklists
from pressloom.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def in_utc(query: Query) -> Query:
    """Runs a query with the session's time zone set to UTC, as all tables are, and the package at hand."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def core_queries() -> dict[str, Query]:
    return {k: in_utc(q) for k, q in {**core_problems.queries(), **reference.queries(), **worklists.queries()}.items()}


def core_oracle() -> dict[str, str]:
    return {**core_problems.oracle_sql(), **reference_sql.oracle_sql(), **worklists.oracle_sql()}
