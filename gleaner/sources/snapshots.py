"""Landed pages: what of a fetch table may be read."""

from __future__ import annotations

from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import urls

PAGE_BYTES = 1_000_000
AGENT = "gleaner"


@lru_cache(1000)
def _rules(text: str) -> RobotFileParser:
    rules = RobotFileParser()
    rules.parse(text.splitlines())
    return rules


@F.pandas_udf(T.BooleanType())
def _may_read(texts: pd.Series, agents: pd.Series, addresses: pd.Series) -> pd.Series:
    return pd.Series([t is None or _rules(t).can_fetch(a, u or "") for t, a, u in zip(texts, agents, addresses, strict=True)], dtype=bool)


def permitted(pages: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """The rows of pages (url) that their hosts' robots files let the agent read.

    robots: (host, text) of the files, by groups of agents with Allow and Disallow lines, of which the first that fits a path
    counts. A host without a file is open; of several files of a host the least text counts.
    """
    rules = robots.groupBy(F.lower("host").alias("_host")).agg(F.min("text").alias("_robots"))
    own = pages.withColumn("_host", urls.host(F.col("url"))).join(rules, "_host", "left")
    # Pages of hosts without a file don't go through Python.
    closed = own.filter("_robots is not null").filter(~_may_read("_robots", F.lit(agent), "url")).select("url").distinct()
    return pages.join(closed, "url", "left_anti").select(pages.columns)


def readable(fetches: DataFrame, robots: DataFrame, limit: int = PAGE_BYTES, agent: str = AGENT) -> DataFrame:
    """(url, html) of fetches (url, content_type, status, html): HTML pages that came back and may be read, their first ``limit`` bytes."""
    own = fetches.filter(F.lower("content_type").contains("html") & F.coalesce(F.col("status") < 400, F.lit(True)))
    cut = F.when(F.octet_length("html") > limit, F.make_valid_utf8(F.substring(F.col("html").cast("binary"), 1, limit).cast("string"))).otherwise(F.col("html"))
    return permitted(own, robots, agent).select("url", cut.alias("html"))
