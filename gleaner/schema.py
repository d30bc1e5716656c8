"""Record schemas. Missing text is the empty string, never null: sources coalesce at their border."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_FIELDS = ("title", "url", "snippet", "directory_email", "directory_phone", "directory_source_url")
LEAD_FIELDS = ("category", "source_url", "website", "email", "company_name", "phone", "page_title", "consent_status")
CSV_FIELDS = ("category", "company_name", "email", "website", "source_url", "page_title", "consent_status", "notes", "discovered_at")

#: Search results with their arrival order: the source's rank and the row's place in it.
SEARCH_RESULT = T.StructType([*(T.StructField(f, T.StringType(), False) for f in RESULT_FIELDS), T.StructField("source_rank", T.IntegerType()), T.StructField("ordinal", T.LongType())])
LEAD = T.StructType([*(T.StructField(f, T.StringType(), False) for f in LEAD_FIELDS), T.StructField("notes", T.ArrayType(T.StringType())), T.StructField("discovered_at", T.TimestampType())])
DIRECTORY_ENTRY = T.StructType([T.StructField(f, T.StringType(), False) for f in ("name", "website", "source_url", "snippet", "email", "phone")])


def text(c: Column | str) -> Column:
    """A column's value, '' for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def as_results(df: DataFrame) -> DataFrame:
    """df with all fields of a search result, '' where it has none, and its order columns (0 where it has none)."""
    own = [text(f).alias(f) if f in df.columns else F.lit("").alias(f) for f in RESULT_FIELDS]
    order = [F.col(c) if c in df.columns else F.lit(0).cast(t).alias(c) for c, t in (("source_rank", "int"), ("ordinal", "long"))]
    return df.select(*own, *order)


def label() -> Column:
    """What a search result is called where people read of it: its address, its directory address, its title, or where it was listed."""
    own = F.coalesce(*(F.when(F.trim(text(c)) != "", F.col(c)) for c in ("url", "directory_email")))
    return F.coalesce(own, *(F.nullif(text(c), F.lit("")) for c in ("title", "directory_source_url")), F.lit("Branchenverzeichnis"))
