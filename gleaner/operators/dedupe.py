"""First-wins deduplication and merges, by explicit arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text, urls

#: Ordinals of a block.
BLOCK = 100_000


def first_wins(df: DataFrame, key: Column, *order: str | Column) -> DataFrame:
    """The first row of each key that isn't null or ''. Grouped top-1: Spark prunes each group before the shuffle."""
    keyed = df.withColumn("_key", key).filter(F.col("_key").isNotNull() & (F.col("_key") != ""))
    first = Window.partitionBy("_key").orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_key")


def dedupe_leads(leads: DataFrame, by: str = "email", *order: str) -> DataFrame:
    """First lead of each address, or with by="email_website" of each pair of address and website. Rows without an address go in the first case."""
    if by == "email":
        return first_wins(leads, text.email_key(F.col("email")), *order)
    return first_wins(leads, F.concat_ws("\t", F.lower("email"), F.lower("website")), *order)


def round_robin(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of several sources by turns: first rows by source_rank, then second ones; first of each URL key, at most limit.

    A row without a URL has the key '', so one of these stays at most. A row's turn is its place in its source, found per block of
    ordinals and then over the blocks' totals, so that no task sorts a whole source.
    """
    blocked = results.withColumn("_block", F.floor(F.col("ordinal") / F.lit(BLOCK)))
    above = Window.partitionBy("source_rank").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("source_rank", "_block").agg(F.count("*").alias("_n"))
    bases = totals.select("source_rank", "_block", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("source_rank", "_block").orderBy("ordinal"))
    turn = blocked.withColumn("_inside", inside).join(bases, ["source_rank", "_block"]).withColumn("turn", F.col("_inside") + F.col("_base")).drop("_block", "_inside", "_base")
    keyed = turn.withColumn("_key", urls.url_key(F.coalesce("url", F.lit(""))))
    first = Window.partitionBy("_key").orderBy("turn", "source_rank")
    merged = keyed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_key")
    return merged.orderBy("turn", "source_rank").limit(limit) if limit is not None else merged


def per_group(df: DataFrame, group: str | Column, n: int | Column, *order: str | Column) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def entries_to_results(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Directory entries (name, website, source_url, snippet, email, phone, ordinal) as search results.

    A row with an external website is known by its URL key and keeps the first of each; it also marks its address
    as seen. A row with an address alone is known by the address and goes if an earlier kept row has it; a row
    with a website comes in though its address was seen. Rows with neither go.
    """
    site = urls.normalize_url(F.col("website"))
    mail = text.directory_email(F.col("email"))
    own = entries.withColumns({"site": F.when(urls.is_external_business_url(site), site).otherwise(""), "mail": mail})
    own = own.withColumn("kind", F.when(F.col("site") != "", "url").when(F.col("mail") != "", "email"))
    own = own.withColumn("_key", F.when(F.col("kind") == "url", urls.url_key(F.col("site"))).otherwise(F.col("mail"))).filter(F.col("kind").isNotNull())
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "_key").orderBy("ordinal"))).filter("_n = 1")
    # An address is marked by the first kept website row that has it; rows without one need no group.
    marks = first.filter((F.col("kind") == "url") & (F.col("mail") != "")).groupBy("mail").agg(F.min("ordinal").alias("_marked"))
    kept = first.join(marks, "mail", "left").filter((F.col("kind") == "url") | F.col("_marked").isNull() | (F.col("_marked") > F.col("ordinal")))
    name = F.coalesce(F.nullif("name", F.lit("")), F.nullif("site", F.lit("")), F.col("mail"))
    snippet = F.coalesce(F.nullif("snippet", F.lit("")), F.concat(F.lit("Branchenverzeichnis: "), F.col("source_url")))
    out = kept.select(
        name.alias("title"), F.col("site").alias("url"), snippet.alias("snippet"), F.col("mail").alias("directory_email"),
        F.trim("phone").alias("directory_phone"), F.col("source_url").alias("directory_source_url"), "ordinal",
    )
    return out.orderBy("ordinal").limit(limit) if limit is not None else out
