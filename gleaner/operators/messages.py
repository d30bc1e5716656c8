"""Bursts of progress messages, folded for a display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of which the last one between two other messages is shown.
FOLDED = ("progress", "site_done", "page")


def coalesced(messages: DataFrame) -> DataFrame:
    """(run, ordinal, kind, text) -> the same, folded: between two messages of other kinds the last progress, site and page count.

    A finished site makes progress before it needless; warnings become one with their number and the last text. Leads are
    all kept. Runs are folded apart, so a run's messages are what one task sorts.
    """
    run = Window.partitionBy("run").orderBy("ordinal")
    barrier = ~F.col("kind").isin(*FOLDED, "warning", "lead")
    own = messages.withColumns({"barrier": barrier, "part": F.sum(barrier.cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1))}).fillna(0, ["part"])
    shown = own.filter(F.col("barrier") | (F.col("kind") == "lead")).select("run", "ordinal", "kind", "text")
    burst = own.filter(~F.col("barrier") & (F.col("kind") != "lead")).groupBy("run", "part", "kind").agg(F.max_by("text", "ordinal").alias("text"), F.max("ordinal").alias("ordinal"), F.count("*").alias("n"))
    warned = F.when((F.col("kind") == "warning") & (F.col("n") > 1), F.concat("n", F.lit("x, last: "), "text")).otherwise(F.col("text"))
    done = Window.partitionBy("run", "part")
    burst = burst.withColumn("done", F.max(F.when(F.col("kind") == "site_done", F.col("ordinal"))).over(done))
    needless = (F.col("kind") == "progress") & F.col("done").isNotNull()
    return shown.unionByName(burst.filter(~needless).select("run", "ordinal", "kind", warned.alias("text")))
