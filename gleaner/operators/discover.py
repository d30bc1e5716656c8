"""A whole run over landed tables: results, pending sites, crawl, verdicts and the cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import accept, crawl


def judged(
    results: DataFrame, pages: DataFrame, robots: DataFrame, opt_out: DataFrame, category: str, ledger: DataFrame | None = None, known_sites: DataFrame | None = None,
    crawled: DataFrame | None = None, max_pages: int = 5, include_personal: bool = False, by: str = "email",
) -> DataFrame:
    """Leads of the results' sites with their verdicts, in the order of results and of the pages of each (ordinal, place).

    Sites that are known (entry) or crawled in an earlier run (key) are left out first. robots: (host, text); opt_out and ledger: (entry).
    """
    spark = results.sparkSession
    crawled = crawled if crawled is not None else spark.createDataFrame([], "key string")
    known_sites = known_sites if known_sites is not None else spark.createDataFrame([], "entry string")
    left = accept.pending(results, crawled, known_sites)
    found = crawl.crawl(left, pages, robots, category, max_pages, include_personal)
    return accept.verdicts(found.withColumn("at", F.struct("ordinal", "place")), opt_out, ledger, by=by, order="at").drop("at")


def discover(verdicts: DataFrame, max_leads: int, already: int = 0) -> DataFrame:
    """The accepted leads of ``judged`` up to the cap, which is checked after each site, without verdict."""
    accepted = verdicts.filter("verdict = 'accepted'").withColumn("site_ordinal", F.col("ordinal"))
    return accept.cap_by_site(accepted, max_leads, already).drop("site_ordinal", "verdict")
