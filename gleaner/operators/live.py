"""Figures of a run while it runs: counted by the writing job itself, told to a status that shows rates and its last events."""

from __future__ import annotations

import time
from collections import deque

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gleaner.operators.stats import per_minute

EVENTS = 40
COUNTS = "rows long, accepted long, business long, duplicates long, suppressed long, known long"


def _counts(verdict: str, consent: str | None) -> list:
    v = F.col(verdict)
    business = F.col(consent) == "business_public" if consent else F.lit(False)
    return [
        F.count("*").alias("rows"), F.count_if(v == "accepted").alias("accepted"), F.count_if((v == "accepted") & business).alias("business"),
        *(F.count_if(v == x).alias(n) for n, x in (("duplicates", "duplicate"), ("suppressed", "suppressed"), ("known", "known"))),
    ]


def observed(leads: DataFrame, verdict: str = "verdict", consent: str | None = "consent_status", at: str | None = None) -> tuple[DataFrame, Observation]:
    """leads, and its counters once they have been written: no second pass. at: a time, whose least and greatest are kept."""
    seen = Observation()
    times = [F.min(at).alias("first_at"), F.max(at).alias("last_at")] if at else []
    return leads.observe(seen, *_counts(verdict, consent), *times), seen


class LiveStatus(StreamingQueryListener):
    """Counters, rates and the last EVENTS events of the streams of a session that observe under ``name``. Add it with spark.streams.addListener."""

    def __init__(self, name: str = "leads", baseline: int = 0, clock=time.monotonic):
        self.name, self.clock = name, clock
        self.baseline, self.began = baseline, clock()
        self.counts: dict[str, int] = {}
        self.phase, self.batches, self.number = "waiting", 0, 0
        self.events: deque[tuple[int, str]] = deque(maxlen=EVENTS)

    def record(self, text: str) -> None:
        """Numbered, so that a reader knows which events it has shown; the oldest goes when the ring is full."""
        self.number += 1
        self.events.append((self.number, text))

    def onQueryStarted(self, event) -> None:
        self.phase = "running"
        self.record(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        own = row.asDict()
        for k, v in own.items():
            if isinstance(v, int):
                self.counts[k] = self.counts.get(k, 0) + v
        self.batches += 1
        self.record(f"batch {event.progress.batchId}: {own.get('accepted', 0)} of {own.get('rows', 0)} rows accepted")

    def onQueryIdle(self, event) -> None:
        self.phase = "idle"

    def onQueryTerminated(self, event) -> None:
        self.phase = "failed" if event.exception else "done"
        self.record(f"{self.phase}{': ' + event.exception[:200] if event.exception else ''}")

    def rate(self, count: str = "accepted") -> float:
        """A minute's rows since the start, without those that an earlier run had."""
        return per_minute(max(0, self.counts.get(count, 0)), self.clock() - self.began)

    def row(self, spark: SparkSession) -> DataFrame:
        """The status as one row, for a sink that a user interface reads."""
        total = self.counts.get("accepted", 0) + self.baseline
        kind = "phase string, leads_found long, leads_per_minute double, rows_per_minute double, batches int, recent_events array<struct<number: long, event: string>>, updated_at timestamp"
        return spark.createDataFrame([(self.phase, total, self.rate(), self.rate("rows"), self.batches, list(self.events))], kind.rpartition(",")[0]).withColumn("updated_at", F.current_timestamp())


def observing(leads: DataFrame, name: str = "leads", verdict: str = "verdict", consent: str | None = None) -> DataFrame:
    """A stream that tells a LiveStatus of each batch's counters."""
    return leads.observe(name, *_counts(verdict, consent))


def rates(counts: dict, seconds: float) -> dict[str, float]:
    """What a status shows for counters after so many seconds."""
    return {f"{k}_per_minute": per_minute(v, seconds) for k, v in counts.items() if isinstance(v, int)}
