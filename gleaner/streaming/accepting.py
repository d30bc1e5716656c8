"""The accept chain over a stream of leads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gleaner.functions import text
from gleaner.operators import accept


def dedupe_stream(leads: DataFrame, time: str | None = None, delay: str = "1 day", by: str = "email") -> DataFrame:
    """One lead per address, or with by="email_website" per pair of address and website. Without an event time the state is unbounded; with one, a key is remembered for delay past the watermark."""
    if by == "email":
        own = leads.withColumn("_key", text.email_key(F.col("email"))).filter("_key <> ''")
    else:
        own = leads.withColumn("_key", F.concat_ws("\t", F.lower("email"), F.lower("website")))
    if time is None:
        return own.dropDuplicates(["_key"]).drop("_key")
    return own.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


class _DomainLedger(StatefulProcessor):
    """Keeps per domain whether a lead was accepted; the first in order of a batch is, later ones are known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "email string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        """A frame at a time; the first lead so far is held back until a batch's end."""
        open_, first = not self.taken.exists(), None
        for own in rows:
            if open_ and len(own):
                own = own if first is None else pd.concat([first, own], ignore_index=True)
                least = own.sort_values(["ordinal", "email"]).index[0]
                first, own = own.loc[[least]], own.drop(index=least)
            if len(own):
                yield pd.DataFrame({"ordinal": own["ordinal"], "email": own["email"], "verdict": "known"})
        if first is not None:
            self.taken.update((first["email"].iloc[0],))
            yield pd.DataFrame({"ordinal": first["ordinal"], "email": first["email"], "verdict": "accepted"})

    def close(self) -> None:
        pass


def ledger_stream(leads: DataFrame, opt_out: DataFrame, ledger: DataFrame) -> DataFrame:
    """(ordinal, email, verdict) of leads that are neither opted out nor in an earlier run's ledger: an accepted one closes its domain at once."""
    own = accept.not_suppressed(leads, opt_out)
    own = accept.in_ledger(own, ledger).filter(~F.col("known"))
    keyed = own.select("ordinal", "email", text.email_domain(F.col("email")).alias("domain"))
    return keyed.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=_DomainLedger(), outputStructType="ordinal long, email string, verdict string", outputMode="Append", timeMode="None"
    )


def write_stream(leads: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Leads as CSV files, a folder of path per batch; a restart goes on from the checkpoint, and a batch that comes again replaces its folder."""
    from gleaner.sinks import write_csv

    def sink(batch: DataFrame, number: int) -> None:
        write_csv(batch, f"{path}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return leads.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()
