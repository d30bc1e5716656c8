"""Run statistics from leads with verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import urls


def lead_stats(verdicts: DataFrame) -> DataFrame:
    """One row of counters. unique_domains counts the websites' hosts of accepted leads, blanks left out."""
    accepted = F.col("verdict") == "accepted"
    business = F.col("consent_status") == "business_public"
    return verdicts.agg(
        F.count_if(accepted).alias("leads_found"),
        F.count_if(accepted & business).alias("business_leads"),
        F.count_if(accepted & ~business).alias("personal_leads"),
        F.count_if(F.col("verdict") == "duplicate").alias("duplicates_skipped"),
        F.count_if(F.col("verdict") == "suppressed").alias("suppressed_skipped"),
        F.count_if(F.col("verdict") == "known").alias("known_skipped"),
        F.count_distinct(F.when(accepted, F.nullif(urls.host(F.col("website")), F.lit("")))).alias("unique_domains"),
    )


def by_status(leads: DataFrame) -> DataFrame:
    return leads.groupBy("consent_status").agg(F.count("*").alias("leads"))


def per_minute(count: float, seconds: float) -> float:
    """A rate as the status line shows it: one decimal, halves to even; 0 before any time has gone by."""
    return round(count / seconds * 60, 1) if seconds > 0 else 0.0
