"""URL and host rules as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.tables import ASSET_SUFFIXES, CONTACT_HINTS, CONTACT_PATHS, HOST_TOKENS, LANGUAGE_PREFIXES, MAP_HOST_MARKERS


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value found once a row, however often use names it: else nested rules repeat their inputs many times over."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def url_key(url: Column) -> Column:
    """Identity of a URL: lower case, without any closing slashes."""
    return F.regexp_replace(F.lower(url), "/+$", "")


def authority(url: Column) -> Column:
    """User info, host and port; '' if there's none or the URL can't be parsed."""
    return F.coalesce(F.try_parse_url(F.trim(url), F.lit("AUTHORITY")), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case authority without a leading www."""
    return F.regexp_replace(F.lower(authority(url)), "^www\\.", "")


def site_key(url: Column) -> Column:
    """Key of the site ledger: the host without leading dots."""
    return F.regexp_replace(F.trim(host(url)), "^\\.+", "")


def is_web_url(url: Column) -> Column:
    """Absolute, http or https, with a host."""
    return scheme(url).isin("http", "https") & (authority(url) != "")


def normalize_url(url: Column) -> Column:
    """Trimmed, with https:// if it has no scheme; '' unless it's then a web URL."""

    def whole(trimmed: Column) -> Column:
        full = F.when(scheme(trimmed) == "", F.concat(F.lit("https://"), trimmed)).otherwise(trimmed)
        return F.when(trimmed != "", _once(full, lambda u: F.when(is_web_url(u), u).otherwise(""))).otherwise("")

    return _once(F.trim(F.coalesce(url, F.lit(""))), whole)


def is_same_site(base: Column, other: Column) -> Column:
    """Equal hosts, or other's is a subdomain of base's."""
    return (host(other) == host(base)) | F.endswith(host(other), F.concat(F.lit("."), host(base)))


def _holds(value: Column, parts: tuple[str, ...] | list[str]) -> Column:
    return value.rlike("|".join(map(re.escape, parts)))


def is_external_business_url(url: Column) -> Column:
    """A web URL, https:// if it has no scheme, whose host is no asset and holds no token of a directory or platform."""
    assets = f"({'|'.join(s.replace('.', '[.]') for s in ASSET_SUFFIXES)})$"
    return _once(normalize_url(url), lambda full: (full != "") & _once(host(full), lambda h: ~h.rlike(assets) & ~_holds(h, HOST_TOKENS)))


def is_external_map_website(url: Column) -> Column:
    """A web URL of a host that isn't the map service's."""
    return _once(normalize_url(url), lambda full: (full != "") & ~_holds(host(full), MAP_HOST_MARKERS))


def looks_like_contact(url: Column, label: Column) -> Column:
    return F.lower(F.concat_ws(" ", url, label)).rlike("|".join(h.replace("-", "\\-") for h in CONTACT_HINTS))


def is_followable(href: Column) -> Column:
    """Not empty, no fragment alone, no mail, phone or script link (prefixes in lower case only)."""
    return (F.coalesce(href, F.lit("")) != "") & ~href.rlike("^(mailto:|tel:|javascript:|#)")


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def guessed_contact_urls(url: Column) -> Column:
    """Contact pages that a site may have: under its language prefix first, if its path begins with one, then at its root."""
    parsed = F.trim(url)
    base = F.concat(F.regexp_extract(parsed, "^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("://"), authority(url))
    path = F.coalesce(F.try_parse_url(parsed, F.lit("PATH")), F.lit(""))
    segment = F.lower(F.split_part(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit(1)))
    paths = F.array(*map(F.lit, CONTACT_PATHS))
    at_root = F.transform(paths, lambda p: F.concat(base, p))
    prefixed = F.transform(paths, lambda p: F.concat(base, F.lit("/"), segment, p))
    every = F.when(segment.isin(LANGUAGE_PREFIXES), F.concat(prefixed, at_root)).otherwise(at_root)
    none = F.array().cast("array<string>")
    return F.when((scheme(url) != "") & (authority(url) != ""), every).otherwise(none)


def crawl_key(url: Column, email: Column, source: Column, title: Column) -> Column:
    """Identity of a search result: its URL, else its address, its directory page, its title."""
    def first(value: Column, key: Column) -> Column:
        return F.when(F.trim(value) != "", key)

    def slashless(value: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(value)), "/+$", "")

    return F.coalesce(
        first(url, slashless(url)),
        first(email, F.concat(F.lit("directory-email:"), F.lower(F.trim(email)))),
        F.when(slashless(source) != "", F.concat(F.lit("directory-source:"), slashless(source))),
        first(title, F.concat(F.lit("directory-title:"), F.lower(F.trim(title)))),
        F.lit("directory-empty"),
    )


def place_key(url: Column) -> Column:
    """Identity of a map place: the lower-case URL up to its query."""
    return F.split_part(F.lower(url), F.lit("?"), F.lit(1))


def normalize_map_url(url: Column) -> Column:
    """Trimmed, // and bare hosts made https, without closing slashes; '' stays ''."""
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(trimmed == "", "").when(trimmed.rlike("(?i)^https?://"), trimmed).otherwise(F.concat(F.lit("https://"), F.regexp_replace(trimmed, "^/+", "")))
    return F.regexp_replace(full, "/+$", "")


def normalize_map_website(url: Column) -> Column:
    """A map entry's own website, '' for the map service's own hosts."""
    return _once(normalize_map_url(url), lambda full: F.when(is_web_url(full) & ~_holds(host(full), MAP_HOST_MARKERS), full).otherwise(""))


def place_name(url: Column) -> Column:
    """The name in a map place's URL, decoded."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), '/maps/place/([^/?#"]+)', 1)
    return F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(raw), raw), "\\s+", " "))
