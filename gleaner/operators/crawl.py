"""A crawl over landed page snapshots.

Each page that may be read is parsed once, where it lies, to what a crawl wants of it (title, contact links, addresses): html isn't shuffled.
Rounds of joins, as many as pages may be visited, then find the pages that a site's frontier can come to: its results' pages and
guesses, and the contact links of pages found so. These few meet their results in a grouped function that visits them in order.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from gleaner.functions import html, urls
from gleaner.lineage import settled
from gleaner.sources.snapshots import permitted
from gleaner.tables import CONTACT_PATHS, LANGUAGE_PREFIXES, ROLE_PREFIXES

LEADS = (
    "category string, source_url string, website string, email string, company_name string, phone string, page_title string, "
    "consent_status string, notes array<string>, ordinal long, place long"
)


def carried_title(seed: Column, title: Column, pages: WindowSpec) -> Column:
    """The last title that isn't empty up to each page, else the seed."""
    so_far = pages.rowsBetween(-(1 << 63), 0)
    return F.coalesce(F.last(F.nullif(title, F.lit("")), ignorenulls=True).over(so_far), seed)


def _status(email: str) -> str:
    letters = "".join(c for c in email.partition("@")[0].lower() if c.isalpha())
    return "business_public" if letters.startswith(tuple(ROLE_PREFIXES)) else "personal_review_required"


def _company(title: str, url: str) -> str:
    return title.split("|")[0].split("-")[0].strip() if title else html.bare_host(url)


def _guesses(url: str) -> list[str]:
    parts = urlsplit(url)
    base = f"{parts.scheme}://{parts.netloc}"
    segment = parts.path.strip("/").partition("/")[0].lower()
    prefixes = [f"/{segment}", ""] if segment in LANGUAGE_PREFIXES else [""]
    return [f"{base}{p}{path}" for p in prefixes for path in CONTACT_PATHS]


def _visit(start: dict, snapshots: dict[str, tuple], max_pages: int, include_personal: bool):
    """(website, email, title) of a site's pages: contact links go before guesses; missing pages use up attempts, not pages."""
    queue = list(dict.fromkeys([start["site_url"], *_guesses(start["site_url"])]))
    attempts_left = max_pages + len(queue) - 1 + 2
    visited: set[str] = set()
    mails: set[str] = set()
    title, fetched = start["title"] or "", 0
    while queue and fetched < max_pages and attempts_left > 0:
        url = queue.pop(0).partition("#")[0]
        if url in visited:
            continue
        visited.add(url)
        attempts_left -= 1
        if url not in snapshots:
            continue
        fetched += 1
        found, links, emails = snapshots[url]
        title = found or title
        for email in emails:
            if email not in mails and (include_personal or _status(email) == "business_public"):
                mails.add(email)
                yield url, email, title
        fresh = [x for x in links if x not in visited and x not in queue]
        queue[:0] = fresh


def _of_directory(start: dict, category: str, include_personal: bool) -> list[tuple]:
    email = html.clean_email(start["directory_email"] or "")
    if not email or (_status(email) != "business_public" and not include_personal):
        return []
    note = f"Branchenverzeichnis: {start['snippet']}" if start["snippet"] else "Branchenverzeichnis"
    title = start["title"] or ""
    source = start["directory_source_url"] or start["url"] or start["snippet"]
    return [(category, source, (start["url"] or "").strip(), email, title, "", title, _status(email), [note], start["ordinal"])]


#: Rows of keys that are broadcast; longer tables are joined by a shuffle.
SMALL = 100_000


def _sent(keys: DataFrame) -> DataFrame:
    """keys, kept, and broadcast if they are few."""
    keys = settled(keys)
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def _read_once(snapshots: DataFrame) -> DataFrame:
    """(site, page_url, title, links, emails) of snapshots (site, page_url, html); of several snapshots of a page the least text is read."""
    key = ["site", "page_url"]
    several = settled(snapshots.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key))  # without html
    one = snapshots
    if not several.isEmpty():
        several = _sent(several)
        least = snapshots.join(several, key, "left_semi").groupBy(key).agg(F.min("html").alias("html"))
        one = snapshots.join(several, key, "left_anti").unionByName(least)
    return settled(one.select(*key, html.read_page_of("html", "page_url").alias("p")).select(*key, "p.*"))


def _reachable(starts: DataFrame, read: DataFrame, max_pages: int) -> DataFrame:
    """The pages that sites' frontiers can come to: the results' pages and guesses, and contact links of pages that were reached before."""
    key = ["site", "page_url"]
    own = starts.filter("site_url <> ''")
    first = own.select("site", urls.strip_fragment(F.col("site_url")).alias("page_url"))
    guessed = own.select("site", F.explode(urls.guessed_contact_urls(F.col("site_url"))).alias("page_url"))
    fresh = _sent(first.unionByName(guessed).distinct())
    seen, parts = fresh, []
    for left in range(max_pages - 1, -1, -1):
        found = settled(read.join(fresh, key, "left_semi"))
        parts.append(found)
        if not left:
            break
        fresh = settled(found.select("site", F.explode("links").alias("page_url")).distinct().join(seen, key, "left_anti"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        fresh = _sent(fresh)
    return reduce(DataFrame.unionByName, parts)


def crawl(results: DataFrame, pages: DataFrame, robots: DataFrame, category: str, max_pages: int = 5, include_personal: bool = False) -> DataFrame:
    """Leads of search results (url, title, snippet, directory_email, directory_source_url, ordinal) from page snapshots (url, html).

    robots: (host, text) of robots files; pages that they close aren't read. The pages that a site's frontier can come to meet
    by host, so a result only sees its own host's snapshots; of several snapshots of a page the least text is read. A result without a
    usable URL, or whose site has no lead, falls back on its directory address. ordinal and place (within the result) are the leads' order.
    """
    starts = results.withColumn("site_url", urls.normalize_url(F.col("url")))
    starts = starts.withColumn("site", F.when(F.col("site_url") != "", urls.host(F.col("site_url"))).otherwise(F.concat(F.lit("#"), F.col("ordinal").cast("string"))))
    # Hosts without a result never leave their partition: the pages' shuffle holds what is crawled only.
    sites = starts.select("site").distinct()
    own = pages.withColumn("site", urls.host(F.col("url"))).join(sites, "site", "left_semi")
    snapshots = permitted(own, robots).select("site", urls.strip_fragment(F.col("url")).alias("page_url"), F.coalesce("html", F.lit("")).alias("html"))
    starts = settled(starts)
    snapshots = _reachable(starts, _read_once(snapshots), max_pages) if max_pages > 0 else _read_once(snapshots).limit(0)

    def run(key: tuple, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        seen = {u: (t, [*k], [*e]) for u, t, k, e in zip(found["page_url"], found["title"], found["links"], found["emails"], strict=True)}
        rows: list[tuple] = []
        for start in own.sort_values("ordinal").to_dict("records"):
            leads = []
            if start["site_url"]:
                notes = [f"Search snippet: {start['snippet']}"] if start["snippet"] else []
                for website, email, title in _visit(start, seen, max_pages, include_personal):
                    leads.append((category, start["url"], website, email, _company(title, website), "", title, _status(email), notes, start["ordinal"]))
            rows += [(*lead, k) for k, lead in enumerate(leads or _of_directory(start, category, include_personal))]
        names = [f.split()[0] for f in LEADS.split(", ")]
        return pd.DataFrame(rows, columns=names)

    columns = ("site", "site_url", "url", "title", "snippet", "directory_email", "directory_source_url", "ordinal")
    return starts.select(*columns).groupBy("site").cogroup(snapshots.groupBy("site")).applyInPandas(run, LEADS)
