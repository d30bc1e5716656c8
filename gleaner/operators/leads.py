"""Lead rows from texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text, urls
from gleaner.schema import CSV_FIELDS

#: Places of addresses in one document; an ordinal is the document's id times this, plus the place.
PLACES = 1 << 24


def leads_of_texts(docs: DataFrame, strict: bool = False) -> DataFrame:
    """A lead per address of each document (doc_id, text, lang, source), in order of document and address."""
    found = (text.strict_emails if strict else text.emails)(F.coalesce("text", F.lit("")))
    each = docs.select("doc_id", "lang", "source", F.posexplode(found).alias("place", "email"))
    website = F.concat(F.lit("https://www."), "source", F.lit(".example/"), "lang")
    return each.select(
        (F.col("doc_id") * PLACES + F.col("place")).alias("ordinal"),
        F.col("lang").alias("category"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_url"),
        website.alias("website"),
        "email",
        text.company_name(F.lit(""), urls.host(website)).alias("company_name"),
        F.lit("").alias("phone"),
        F.lit("").alias("page_title"),
        text.classify_email(F.col("email")).alias("consent_status"),
        F.col("doc_id").alias("site_ordinal"),
    )


def csv_rows(leads: DataFrame) -> DataFrame:
    """The columns of the CSV sink, notes joined; the phone isn't among them."""
    notes = F.concat_ws("; ", "notes") if "notes" in leads.columns else F.lit("")
    at = F.date_format("discovered_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'") if "discovered_at" in leads.columns else F.lit("")
    made = {"notes": notes, "discovered_at": at}
    return leads.select(*(made[c].alias(c) if c in made else F.col(c) for c in CSV_FIELDS))
