"""What becomes of a lead: opt-out lists, ledgers of earlier runs, duplicates and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text, urls


def lines(df: DataFrame, lower: bool = True) -> DataFrame:
    """A text table (value) as entries: trimmed, without blank lines and # comments."""
    own = F.trim("value")
    return df.select((F.lower(own) if lower else own).alias("entry")).filter((F.col("entry") != "") & ~F.startswith("entry", F.lit("#"))).distinct()


def _known(leads: DataFrame, entries: DataFrame, flag: str, bare_domains: bool) -> DataFrame:
    """leads with flag: the address, or its domain as @domain (or alone), is an entry. Two equi-joins, as an OR would be a nested loop."""
    mails = entries.select(F.col("entry").alias("_mail")).distinct()
    domains = entries.filter(F.startswith("entry", F.lit("@"))).select(F.substr("entry", F.lit(2)).alias("_domain"))
    if bare_domains:
        domains = domains.union(entries.select("entry"))
    mails, domains = mails.withColumn("_m", F.lit(True)), domains.distinct().withColumn("_d", F.lit(True))
    own = leads.withColumns({"_mail": F.lower("email"), "_domain": text.email_domain(F.col("email"))})
    joined = own.join(mails, "_mail", "left").join(domains, "_domain", "left")
    return joined.withColumn(flag, F.coalesce("_m", F.lit(False)) | F.coalesce("_d", F.lit(False))).drop("_mail", "_domain", "_m", "_d")


def suppressed(leads: DataFrame, entries: DataFrame) -> DataFrame:
    """leads with suppressed: the address, the domain or @domain is on the opt-out list (entry, in lower case); no subdomains."""
    return _known(leads, entries, "suppressed", True)


def not_suppressed(leads: DataFrame, entries: DataFrame) -> DataFrame:
    return suppressed(leads, entries).filter(~F.col("suppressed")).drop("suppressed")


def in_ledger(leads: DataFrame, ledger: DataFrame) -> DataFrame:
    """leads with known: the ledger (entry) holds the address or @domain."""
    return _known(leads, ledger, "known", False)


def ledger_entries(accepted: DataFrame) -> DataFrame:
    """What accepted leads add to the ledger: the address and @domain of each."""
    mail = text.email_key(F.col("email"))
    each = F.explode(F.array(mail, F.concat(F.lit("@"), text.email_domain(F.col("email")))))
    return accepted.filter(mail != "").select(each.alias("entry")).distinct()


def verdicts(leads: DataFrame, opt_out: DataFrame, ledger: DataFrame | None = None, seeds: DataFrame | None = None, by: str = "email", order: str = "ordinal") -> DataFrame:
    """leads with verdict: suppressed, known, duplicate or accepted, as a row-by-row run in arrival order would say.

    With a ledger, an accepted lead closes its domain at once, so later ones of the domain are known. seeds: addresses (entry)
    of an interrupted run, whose leads are duplicates. A lead without an address is a duplicate. Leads that tie in the order
    come by address and website; of equal ones one is accepted.
    """
    own = suppressed(leads, opt_out)
    own = in_ledger(own, ledger) if ledger is not None else own.withColumn("known", F.lit(False))
    mail = text.email_key(F.col("email"))
    own = own.withColumn("_key", mail if by == "email" else F.concat_ws("\t", F.lower("email"), F.lower("website")))
    if seeds is not None:
        own = own.join(seeds.select(F.col("entry").alias("_key"), F.lit(True).alias("_seed")).distinct(), "_key", "left")
    else:
        own = own.withColumn("_seed", F.lit(None).cast("boolean"))
    own = own.withColumn("_out", F.coalesce("_seed", F.lit(False)) | ((mail == "") if by == "email" else F.lit(False)))
    group = text.email_domain(F.col("email")) if ledger is not None else F.col("_key")
    eligible = ~F.col("suppressed") & ~F.col("known") & ~F.col("_out")
    own = own.withColumn("_group", group)
    own = own.withColumn("_rank", F.struct(order, "email", "website", F.xxhash64(*leads.columns)))
    firsts = own.filter(eligible).groupBy("_group").agg(F.min("_rank").alias("_first"))  # partial sums first: a hot domain is one row per task
    own = own.join(firsts, "_group", "left")
    # Of equal first rows one counts; the others are spread, so that a hot domain is no window's alone.
    first = eligible & (F.col("_first") == F.col("_rank"))
    own = own.withColumn("_tie", F.when(first, 0).otherwise(F.xxhash64("_rank")))
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("_group", "_tie").orderBy("_rank")))
    first = first & (F.col("_n") == 1)
    verdict = F.when(F.col("suppressed"), "suppressed").when(F.col("known"), "known").when(first, "accepted")
    if ledger is not None:
        verdict = verdict.when(F.col("_first") <= F.col("_rank"), "known")
    return own.withColumn("verdict", verdict.otherwise("duplicate")).drop("_key", "_seed", "_out", "_group", "_rank", "_first", "_tie", "_n", "suppressed", "known")


def pending(results: DataFrame, crawled: DataFrame, known_sites: DataFrame) -> DataFrame:
    """Results (with columns of a search result) that are neither crawled (key) nor of a known site (entry)."""
    key = urls.crawl_key(F.col("url"), F.col("directory_email"), F.col("directory_source_url"), F.col("title"))
    left = results.withColumn("_k", key).join(crawled.select(F.col("key").alias("_k")), "_k", "left_anti").drop("_k")
    own = left.withColumn("_s", urls.site_key(F.col("url")))
    return own.join(known_sites.filter("entry <> ''").select(F.col("entry").alias("_s")), "_s", "left_anti").drop("_s")


def without_completed(plans: DataFrame, completed: DataFrame, *keys: str) -> DataFrame:
    """Plans that a run hasn't completed; duplicates stay."""
    return plans.join(completed, list(keys), "left_anti")


def cap_by_site(leads: DataFrame, max_leads: int, already: int = 0) -> DataFrame:
    """Leads (site_ordinal) of the sites that begin while the accepted leads before them are under max_leads.

    The check comes after a whole site, so the last one may overshoot, and the first always runs. The running sum is
    over one row per site that has leads, found per block of sites and then over the blocks' totals.
    """
    per_site = leads.groupBy("site_ordinal").agg(F.count("*").alias("_n"))
    blocked = per_site.withColumn("_block", F.floor(F.col("site_ordinal") / F.lit(10_000)))
    before_blocks = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("_block").agg(F.sum("_n").alias("_total")).select("_block", F.coalesce(F.sum("_total").over(before_blocks), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy("site_ordinal").rowsBetween(Window.unboundedPreceding, -1)
    upto = blocked.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(blocks, "_block")
    kept = upto.filter((F.col("_base") + F.col("_inside") + F.lit(already) < max_leads) | (F.col("_base") + F.col("_inside") == 0)).select("site_ordinal")
    return leads.join(kept, "site_ordinal", "left_semi")


def batch_cap(leads: DataFrame, opt_out: DataFrame, max_leads: int, *order: str) -> DataFrame:
    """Batch mode's order: duplicates by address go, then the cap, then opted-out leads, so fewer than the cap may stay."""
    from gleaner.operators.dedupe import dedupe_leads

    return not_suppressed(dedupe_leads(leads, "email", *order).orderBy(*order).limit(max_leads), opt_out)
