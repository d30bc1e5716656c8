"""What needs an HTML parser or a byte-wise decoding: Arrow-batched functions over columns of html."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions.text import EDGE_MARKS, RE2_EMAIL, SPELLED
from gleaner.tables import ASSET_SUFFIXES, CONTACT_HINTS, TRUSTED_TLDS

_EMAIL = re.compile(RE2_EMAIL, re.ASCII)
_CF = re.compile(r'data-cfemail="([0-9a-fA-F]+)"')
_COMMENT = re.compile(r"<!--.*?-->", re.DOTALL)
_TAG = re.compile(r"<[^>]+>")
_TLDS = frozenset(TRUSTED_TLDS)


def clean_email(raw: str) -> str:
    value = html.unescape(raw).strip().lower()
    for spelled, sign in SPELLED:
        value = value.replace(spelled, sign)
    return "".join(value.split()).strip(EDGE_MARKS)


def cf_email(encoded: str) -> str:
    """An address hidden as hexadecimal bytes, of which the first is the key of the others; '' if it's none."""
    if len(encoded) % 2 or not re.fullmatch("[0-9a-fA-F]{4,}", encoded):
        return ""
    key, *rest = bytes.fromhex(encoded)
    plain = "".join(chr(b ^ key) for b in rest)
    return plain if "@" in plain else ""


def page_emails(page: str) -> list[str]:
    """Addresses of a page's source, sorted: plain ones, ones split by tags (with a trusted ending), and encoded ones."""
    found = {clean_email(m) for m in _EMAIL.findall(html.unescape(page))}
    if "<" in page and (bare := _TAG.sub("", _COMMENT.sub("", page))) != page:
        # Without tags, neighbouring cells run together: only trusted endings count.
        found |= {e for m in _EMAIL.findall(html.unescape(bare)) if (e := clean_email(m)).rpartition(".")[2] in _TLDS}
    found |= {clean_email(cf_email(m)) for m in _CF.findall(page)}
    return sorted(e for e in found if e and not e.endswith(ASSET_SUFFIXES))


def bare_host(url: str) -> str:
    try:
        return urlsplit(url).netloc.lower().removeprefix("www.")
    except ValueError:
        return ""


class _Page(HTMLParser):
    """Collects the last title and all anchors with their titles or labels."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title = ""
        self.anchors: list[tuple[str, str]] = []
        self.inside, self.heard = False, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "title":
            self.inside = True
        elif tag == "a":
            own = {k: v or "" for k, v in attrs}
            self.anchors.append((own.get("href", ""), own.get("title") or own.get("aria-label", "")))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.inside, self.title = False, " ".join(" ".join(self.heard).split())

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.heard.append(data)


def contact_links(anchors: list[tuple[str, str]], base: str) -> list[str]:
    """Absolute links of the same site that look like contact pages by address or label, without fragments, sorted."""
    own, found = bare_host(base), set()
    for href, label in anchors:
        if not href or href.startswith(("mailto:", "tel:", "javascript:", "#")):
            continue
        try:
            url = urljoin(base, href)
        except ValueError:
            continue
        there = bare_host(url)
        if (there == own or there.endswith("." + own)) and any(h in f"{url} {label}".lower() for h in CONTACT_HINTS):
            found.add(url.partition("#")[0])
    return sorted(found)


def parse_page(page: str, base: str) -> tuple[str, list[str]]:
    """Title and contact links of a page."""
    own = _Page()
    own.feed(page)
    return own.title, contact_links(own.anchors, base)


PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("links", T.ArrayType(T.StringType()))])


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_emails_of(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: page_emails(p or ""))


@F.pandas_udf(PAGE)
def parse_page_of(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(p or "", b or "") for p, b in zip(pages, bases, strict=True)], columns=["title", "links"])


READ = T.StructType([*PAGE.fields, T.StructField("emails", T.ArrayType(T.StringType()))])


@F.pandas_udf(READ)
def read_page_of(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
    """What a crawl wants of a page: title, contact links, addresses."""
    return pd.DataFrame([(*parse_page(p or "", b or ""), page_emails(p or "")) for p, b in zip(pages, bases, strict=True)], columns=READ.names)


@F.pandas_udf(T.StringType())
def unescaped(values: pd.Series) -> pd.Series:
    return values.map(lambda v: html.unescape(v) if v and "&" in v else v)


@F.pandas_udf(T.StringType())
def cf_email_of(values: pd.Series) -> pd.Series:
    return values.map(lambda v: cf_email(v or ""))
