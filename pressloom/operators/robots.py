"""Robots rules as tables: which agent may fetch which path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rules(files: DataFrame) -> DataFrame:
    """``site, agent, kind, prefix`` of robots files (site, text): agents named together share the rules below them.

    Files become a table of directives. A naming line after a rule begins a new section; rules of a
    section go to all agents it names, rules before any section to none. An agent without rules has one
    row with null ``kind``. Lines that are no directive do not matter; a null text has no rules.
    """
    lines = files.select("site", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("at", "line")).withColumn("line", F.substring_index("line", "#", 1))
    said = lines.filter(F.col("line").contains(":")).select(
        "site", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("word"), F.trim(F.regexp_extract("line", r"(?s)^[^:]*:(.*)$", 1)).alias("value")
    ).filter(F.col("word").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("site").orderBy("at")  # one site's file
    names = F.col("word") == "user-agent"
    begins = names & F.coalesce(F.lag("word").over(order) != "user-agent", F.lit(True))
    said = said.withColumn("section", F.sum(begins.cast("int")).over(order)).filter("section > 0")
    agents = said.filter(names).select("site", "section", F.lower("value").alias("agent")).distinct()
    told = said.filter(~names).select("site", "section", F.col("word").alias("kind"), F.col("value").alias("prefix"))
    return agents.join(told, ["site", "section"], "left").select("site", "agent", "kind", "prefix")


def decisions(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (site, agent, path) with ``via`` and ``allowed``.

    The agent's own group, else ``*``; the longest matching prefix decides, the first of equal ones is
    not told apart; an empty Disallow and no match allow.
    """
    ask = requests.select("site", F.lower("agent").alias("agent"), "path").distinct()
    named = rules.select("site", "agent").distinct().withColumn("named", F.lit(True))
    ask = ask.join(named, ["site", "agent"], "left").withColumn("via", F.when(F.col("named"), F.col("agent")).otherwise(F.lit("*"))).drop("named")
    r = rules.filter("kind is not null and prefix <> ''").select("site", F.col("agent").alias("via"), "kind", "prefix")
    hit = ask.join(r, ["site", "via"], "left").withColumn("kind", F.when(F.col("path").startswith(F.regexp_replace("prefix", r"\$+$", "")), F.col("kind")))
    best = hit.groupBy("site", "agent", "path", "via").agg(F.max_by("kind", F.when(F.col("kind").isNotNull(), F.length("prefix"))).alias("kind"))
    return best.select("site", "agent", "path", "via", (F.coalesce("kind", F.lit("allow")) == "allow").alias("allowed"))
