"""Searches over several sources: which are asked, and how their rows come together."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.lineage import settled
from gleaner.operators import accept, dedupe
from gleaner.plans import planning
from gleaner.schema import as_results
from gleaner.sources import directories
from gleaner.sources.providers import SOURCE_RANKS

#: Sources that need a key; the others are always asked.
KEYED = ("google", "brave", "bing", "serpapi", "maps", "zenrows")
FREE = ("osm", "duckduckgo", "directories")


def asked(keys: dict[str, str], only: str = "") -> list[str]:
    """Names of the sources of a combined search, in their fixed order; or the one asked for."""
    if only and only not in SOURCE_RANKS:
        raise ValueError(f"no such source: {only}")
    names = [only] if only else [n for n in SOURCE_RANKS if n in FREE or (n in KEYED and keys.get(n))]
    return sorted(names, key=SOURCE_RANKS.__getitem__)


def combined(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], limit: int, tell: Callable[[str], None] = lambda _: None) -> DataFrame:
    """Rows of all sources by turns, first of each URL, at most limit. A source that fails, when planned or when read, gives none, and is told of."""
    if limit < 1:
        return spark.createDataFrame([], "title string, url string, snippet string, directory_email string, directory_phone string, directory_source_url string, source_rank int, ordinal long, turn int")
    rows, failed = None, []
    for name in sorted(sources, key=SOURCE_RANKS.__getitem__):
        try:
            own = settled(as_results(sources[name]()).withColumn("source_rank", F.lit(SOURCE_RANKS[name])))
        except (PySparkException, Py4JError, OSError) as e:  # one source's failure leaves the others' rows
            failed.append(f"{name}: {str(e)[:200]}")
            tell(failed[-1])
            continue
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        raise ValueError("; ".join(failed) or "no source could be asked")
    return dedupe.round_robin(rows, limit)


def until_stale(items: DataFrame, pages: DataFrame, query: str, key: Column) -> DataFrame:
    """Items (query, page) of paged answers up to each query's first landed page (query, page) that is empty or has no key that earlier pages hadn't."""
    firsts = items.select(query, "page", key.alias("_key")).groupBy(query, "_key").agg(F.min("page").alias("page"))
    news = firsts.groupBy(query, "page").agg(F.count("*").alias("_news"))
    stops = pages.select(query, "page").distinct().join(news, [query, "page"], "left_anti").groupBy(query).agg(F.min("page").alias("_stop"))
    return items.join(stops, query, "left").filter(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).drop("_stop")


def _stops(items: DataFrame, pages: DataFrame, query: str, patience: int, most_offset: int | None, most_pages: int | None) -> DataFrame:
    """(query, _stop): the first page whose rows don't count. items have _key, and _first: whether the row is its key's first."""
    news = items.filter("_first").groupBy(query, "page").agg(F.count("*").alias("_news"))
    held = items.groupBy(query, "page").agg(F.count("*").alias("_links"))
    own = pages.join(held, [query, "page"], "left").join(news, [query, "page"], "left")
    in_order = Window.partitionBy(query).orderBy("page")
    own = own.withColumn("_place", F.row_number().over(in_order)).withColumn("_stale", F.col("_news").isNull())
    # Pages in a row that bring nothing new are an island: what their place less their place among such pages has in common.
    own = own.withColumn("_island", F.col("_place") - F.row_number().over(Window.partitionBy(query, "_stale").orderBy("page")))
    own = own.withColumn("_run", F.when(F.col("_stale"), F.row_number().over(Window.partitionBy(query, "_stale", "_island").orderBy("page"))))
    over = F.col("_links").isNull() | F.coalesce(F.col("_run") >= patience, F.lit(False))
    if most_offset is not None:
        over = over | (F.col("offset") > most_offset)
    if most_pages is not None:
        over = over | (F.col("_place") > most_pages)
    return own.filter(over).groupBy(query).agg(F.min("page").alias("_stop"))


def paged(items: DataFrame, pages: DataFrame, query: str, key: Column, patience: int = 2, most_offset: int | None = None, most_pages: int | None = None, shared: bool = False) -> DataFrame:
    """The first item of each key that paging with patience comes to. items (query, page, ordinal), pages (query, page, offset; whole numbers for query with ``shared``).

    A query's paging ends before a page without items, after ``patience`` pages in a row without a new key, before a page whose offset is over
    ``most_offset``, and after ``most_pages`` pages. What is new is told within the query, or, if ``shared``, among all queries in their order: then a
    query's stop changes what is new to later ones, so stops are found in rounds, each of which settles one more query at least, till none moves.
    """
    keyed = items.withColumn("_key", key)
    pages = pages.select(query, "page", "offset").dropDuplicates([query, "page"])
    groups, order = (["_key"], F.struct(query, "page", "ordinal")) if shared else ([query, "_key"], F.struct("page", "ordinal"))
    own = keyed.groupBy(query, "_key").agg(F.min(F.struct("page", "ordinal")).alias("_own"))
    marked = keyed.join(own, [query, "_key"]).withColumn("_first", F.struct("page", "ordinal") == F.col("_own")).drop("_own")
    stops = settled(_stops(marked, pages, query, patience, most_offset, most_pages))
    while shared:
        # A key that an earlier query has come to before its stop isn't new.
        counted = keyed.join(stops, query, "left").filter(F.col("_stop").isNull() | (F.col("page") < F.col("_stop")))
        earlier = counted.groupBy("_key").agg(F.min(query).alias("_by"))
        again = marked.join(earlier, "_key", "left").withColumn("_first", F.col("_first") & (F.col("_by").isNull() | (F.col("_by") >= F.col(query)))).drop("_by")
        found = settled(_stops(again, pages, query, patience, most_offset, most_pages))
        moved = not found.exceptAll(stops).isEmpty() or not stops.exceptAll(found).isEmpty()
        stops = found
        if not moved:
            break
    kept = keyed.join(stops, query, "left").filter(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).drop("_stop")
    firsts = kept.groupBy(*groups).agg(F.min(order).alias("_at"))
    return kept.join(firsts, groups).filter(order == F.col("_at")).drop("_key", "_at")


def directory_search(listing_pages: DataFrame, detail_pages: DataFrame, limit: int, completed: DataFrame | None = None, mode: str = "normal") -> DataFrame:
    """Results of directories over landed pages (with location), without locations that an earlier run completed."""
    own = accept.without_completed(listing_pages, completed, "location") if completed is not None else listing_pages
    caps = planning.DIRECTORY_CAPS[mode]
    rows = directories.entries(own.filter(F.col("page") <= caps.pages), detail_pages, caps.details, caps.source)
    found = dedupe.entries_to_results(rows.drop("scraper_key"), limit)
    return as_results(found.withColumn("source_rank", F.lit(SOURCE_RANKS["directories"])))


def site_rows(results: DataFrame, limit: int) -> DataFrame:
    """Results of searches narrowed to source domains (domain_rank): a share of the limit per domain, first of each URL."""
    from gleaner.functions import urls

    share = dedupe.per_group(results, "domain_rank", planning.per_domain_limit(limit), "ordinal")
    return dedupe.first_wins(share, urls.url_key(F.col("url")), "domain_rank", "ordinal").orderBy("domain_rank", "ordinal").limit(limit)
