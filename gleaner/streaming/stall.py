"""Sites that fall silent: a stream that closes a site after a time without results and discards what comes later.

The clock is event time: a site's timer is set to its last result plus the limit, and fires when the watermark has
passed it, or when a result shows that the limit has gone by. What a site's results are called depends on
their times only, not on how they come in batches, as long as none is later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERDICTS = "site string, result long, at_ms long, verdict string"


class _Watch(StatefulProcessor):
    """Per site the time of its last result, and whether it's closed."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, closed boolean")

    def _rows(self, site: str, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(site, *r) for r in rows], columns=["site", "result", "at_ms", "verdict"]).astype({"result": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, closed = self.seen.get() if self.seen.exists() else (None, False)
        own = pd.concat([r[["at_ms", "result"]] for r in rows]).sort_values(["at_ms", "result"])
        out: list[tuple] = []
        for at, result in zip(own["at_ms"].tolist(), own["result"].tolist(), strict=True):
            if not closed and last is not None and at - last > self.limit:
                closed = True
                out.append((None, last + self.limit, "evicted"))
            if closed:
                out.append((result, at, "late"))
            else:
                last = at if last is None else max(last, at)
                out.append((result, at, "on_time"))
        self.seen.update((last, closed))
        if not closed:
            self.handle.registerTimer(last + self.limit)
        yield self._rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.seen.exists():
            return
        last, closed = self.seen.get()
        at = last + self.limit
        if closed or at > expiredTimerInfo.getExpiryTimeInMs():
            return  # closed by a later result, or the site went on and has a later timer
        self.seen.update((last, True))
        yield self._rows(key[0], [(None, at, "evicted")])

    def close(self) -> None:
        pass


def watched(results: DataFrame, site: str, result: str, time: str, limit_seconds: float, delay: str = "0 seconds") -> DataFrame:
    """A stream of results -> (site, result, at_ms, verdict): on_time, evicted (a row without result, once a site), or late.

    Rows without a site or a time are left out. Results of a site in one batch are sorted together; a batch's size is the reader's to bound.
    """
    own = results.filter(F.col(site).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    own = own.select(F.col(site).cast("string").alias("site"), F.col(result).cast("long").alias("result"), F.unix_millis(time).alias("at_ms"), F.col(time))
    return own.groupBy("site").transformWithStateInPandas(
        statefulProcessor=_Watch(int(limit_seconds * 1000)), outputStructType=VERDICTS, outputMode="Append", timeMode="EventTime"
    )


def accepted(verdicts: DataFrame) -> DataFrame:
    """The results that count: those that came in time."""
    return verdicts.filter("verdict = 'on_time'").drop("verdict")
