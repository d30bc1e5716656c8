"""What a fetch log's messages say about trying again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of an answer, and parts of messages, after which another try may help.
TRANSIENT_STATES = (408, 425, 429, 500, 502, 503, 504)
SEARCH_HINTS = ("timed out", "timeout", "temporarily unavailable")
DIRECTORY_HINTS = (
    "timed out", "timeout", "connection reset", "reset by peer", "10054", "10053", "connection aborted", "connection refused", "temporarily unavailable",
    "remotehost geschlossen", "http error 429", "http error 500", "http error 502", "http error 503", "http error 504",
)


def is_transient_state(status: Column) -> Column:
    return status.isin(*TRANSIENT_STATES)


def is_retryable_search_error(message: Column) -> Column:
    return F.lower(message).rlike("|".join(SEARCH_HINTS)) | message.rlike(f"HTTP Error ({'|'.join(map(str, TRANSIENT_STATES))}):")


def is_transient_directory_error(message: Column) -> Column:
    return F.lower(message).rlike("|".join(DIRECTORY_HINTS))


#: What to do about a certificate that can't be checked.
CERTIFICATE_HELP = "The certificate can't be checked: update the machine's certificates."


def formatted(status: Column, reason: Column, message: Column) -> Column:
    """A fetch log's failure as one text: an answer's state and reason, else the reason (with what helps, for a certificate's), else the message."""
    certificate = F.lower(reason).rlike("ssl|certificate")
    told = F.when(certificate, F.concat(reason, F.lit(". "), F.lit(CERTIFICATE_HELP))).otherwise(reason)
    return F.coalesce(F.when(status.isNotNull(), F.concat(F.lit("HTTP Error "), status.cast("string"), F.lit(": "), F.coalesce(reason, F.lit("")))), told, message, F.lit(""))
