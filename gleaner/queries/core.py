"""Queries of URL, text, dedupe, accept and statistics operators over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import html, text, urls
from gleaner.functions.text import EDGE_MARKS, EMAIL_PATTERN, PHONE_PATTERN, SPELLED
from gleaner.operators import accept, crawl, dedupe, discover, leads, stats
from gleaner.tables import ASSET_SUFFIXES, CONTACT_PATHS, HOST_TOKENS, LANGUAGE_PREFIXES, ROLE_PREFIXES, TRUSTED_TLDS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Entries of an opt-out list and of an earlier run's ledger, for addresses of the test documents.
OPT_OUT = ("mail1.example.com", "@mail3.example.com", "hees.the")
LEDGER = ("@mail2.example.com", "@mail5.example.com")
MAX_LEADS = 25


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark: SparkSession, entries: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(e,) for e in entries], "entry string")


def _leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.leads_of_texts(_read(spark, sf_dir, "documents"))


# SQL parts. The patterns are the same texts; DuckDB takes the flag as an option.
_HOST = r"regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"
_NORM = "trim(lower(m))"
for _a, _b in SPELLED:
    _NORM = f"replace({_NORM}, '{_a}', '{_b}')"
_NORM = f"trim(regexp_replace({_NORM}, '\\s+', '', 'g'), '{EDGE_MARKS.replace(chr(39), chr(39) * 2)}')"
_ASSET = "|".join(s.replace(".", "[.]") for s in ASSET_SUFFIXES)
_CLASS = f"CASE WHEN regexp_matches(regexp_replace(lower(split_part(email, '@', 1)), '[^\\p{{L}}]', '', 'g'), '^({'|'.join(ROLE_PREFIXES)})') THEN 'business_public' ELSE 'personal_review_required' END"
_MAILS = f"""mails AS (
  SELECT DISTINCT doc_id, lang, source, email FROM (SELECT doc_id, lang, source, {_NORM} AS email FROM (
    SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '{EMAIL_PATTERN}', 0, 'i')) AS m FROM documents))
  WHERE email <> '' AND NOT regexp_matches(email, '({_ASSET})$'))"""
_LEADS = f"""{_MAILS},
leads AS (
  SELECT doc_id * {leads.PLACES} + row_number() OVER (PARTITION BY doc_id ORDER BY email) - 1 AS ordinal, lang AS category, 'doc:' || doc_id AS source_url,
    'https://www.' || source || '.example/' || lang AS website, email, source || '.example' AS company_name, {_CLASS} AS consent_status, doc_id AS site_ordinal,
    CASE WHEN contains(email, '@') THEN regexp_replace(email, '^[^@]*@', '') ELSE email END AS domain
  FROM mails)"""
_OPT = "domain IN ({0}) OR email IN ({0})".format(", ".join(f"'{e.lstrip('@')}'" for e in OPT_OUT))
_LED = "domain IN ({0})".format(", ".join(f"'{e.lstrip('@')}'" for e in LEDGER))


@query(f"SELECT page_id, rtrim(lower(url), '/') AS url_key, {_HOST.format('url')} AS host FROM pages")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", urls.url_key(F.col("url")).alias("url_key"), urls.host(F.col("url")).alias("host"))


@query(f"SELECT {_HOST.format('url')} AS host, count(*) AS pages, min(page_id) AS first_page FROM pages WHERE {_HOST.format('url')} <> '' GROUP BY 1")
def host_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "pages").select("page_id", F.nullif(urls.host(F.col("url")), F.lit("")).alias("host")).dropna()
    return own.groupBy("host").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query(
    f"""SELECT page_id, {_HOST.format('url')} = 'tionsh.example.net' OR ends_with({_HOST.format('url')}, '.example.net') AS same_site,
  NOT list_has_any([{', '.join(f"contains({_HOST.format('url')}, '{t}')" for t in HOST_TOKENS)}], [true]) AS external FROM pages"""
)
def site_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    same = (urls.host(url) == "tionsh.example.net") | urls.is_same_site(F.lit("https://example.net/"), url) & (urls.host(url) != "example.net")
    return _read(spark, sf_dir, "pages").select("page_id", same.alias("same_site"), urls.is_external_business_url(url).alias("external"))


_PREFIXES = ", ".join(f"'{p}'" for p in LANGUAGE_PREFIXES)
_PATHS = ", ".join(f"'{p}'" for p in CONTACT_PATHS)


@query(
    f"""SELECT page_id, unnest(CASE WHEN seg IN ({_PREFIXES}) THEN list_concat(list_transform([{_PATHS}], lambda p: base || '/' || seg || p), list_transform([{_PATHS}], lambda p: base || p))
  ELSE list_transform([{_PATHS}], lambda p: base || p) END) AS guess
FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') AS base, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*/+([^/?#]*)', 1)) AS seg FROM pages)"""
)
def contact_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(urls.guessed_contact_urls(F.col("url"))).alias("guess"))


@query(f"WITH {_MAILS} SELECT doc_id, email, {_CLASS} AS consent_status FROM mails")
def email_extract_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "documents").select("doc_id", F.explode(text.emails(F.coalesce("text", F.lit("")))).alias("email"))
    return own.select("doc_id", "email", text.classify_email(F.col("email")).alias("consent_status"))


@query(
    f"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL_PATTERN}', 0, 'i')) AS m FROM documents)
SELECT DISTINCT doc_id, email FROM (SELECT doc_id, {_NORM} AS email FROM x WHERE regexp_matches(m, '@|\\[at\\]|\\(at\\)|&#64;|&commat;')) WHERE email <> '' AND NOT regexp_matches(email, '({_ASSET})$')"""
)
def email_extract_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.explode(text.strict_emails(F.coalesce("text", F.lit("")))).alias("email"))


_BARE = r"regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]+>', '', 'g')"
_SIGNS = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
#: Addresses of pages: of the source, and of the text without tags, where cells run together, those with a trusted ending.
_PAGE_MAILS = f"""page_mails AS (
  SELECT DISTINCT page_id, email FROM (
    SELECT page_id, {_NORM} AS email, false AS bare FROM (SELECT page_id, unnest(regexp_extract_all({_SIGNS.format("html")}, '{EMAIL_PATTERN}', 0, 'i')) AS m FROM pages)
    UNION ALL SELECT page_id, {_NORM}, true FROM (SELECT page_id, unnest(regexp_extract_all({_SIGNS.format(_BARE)}, '{EMAIL_PATTERN}', 0, 'i')) AS m FROM pages))
  WHERE email <> '' AND NOT regexp_matches(email, '({_ASSET})$') AND (NOT bare OR regexp_extract(email, '[^.]*$') IN ({", ".join(f"'{t}'" for t in TRUSTED_TLDS)})))"""


@query(f"WITH {_PAGE_MAILS} SELECT page_id, email FROM page_mails")
def email_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(html.page_emails_of("html")).alias("email"))


@query(
    f"SELECT doc_id, trim(regexp_replace(p, '\\s+', ' ', 'g')) AS phone FROM (SELECT doc_id, regexp_extract(text, '{PHONE_PATTERN}') AS p FROM documents) WHERE p <> ''"
)
def phone_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "documents").select("doc_id", text.phone(F.coalesce("text", F.lit(""))).alias("phone"))
    return own.filter("phone <> ''")


_TITLES = (
    f"""SELECT page_id, title, CASE WHEN title <> '' THEN trim(split_part(split_part(title, '|', 1), '-', 1)) ELSE {_HOST.format('url')} END AS company
FROM (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\\s+', ' ', 'g')) AS title FROM pages)"""
)


@query(_TITLES)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "pages").select("page_id", "url", html.parse_page_of("html", "url").alias("p")).select("page_id", "url", F.col("p.title").alias("title"))
    return own.select("page_id", "title", text.company_name(F.col("title"), urls.host(F.col("url"))).alias("company"))


@query(
    f"""WITH {_LEADS} SELECT category, company_name, email, website, source_url, '' AS page_title, consent_status, '' AS notes, '' AS discovered_at
FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ordinal) AS n FROM leads WHERE NOT ({_OPT})) WHERE n = 1"""
)
def leads_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to leads: addresses, classes, opt-outs, one lead per address, the CSV's columns."""
    kept = accept.not_suppressed(_leads(spark, sf_dir), _entries(spark, OPT_OUT))
    return leads.csv_rows(dedupe.dedupe_leads(kept, "email", "ordinal"))


@query(f"WITH {_LEADS} SELECT ordinal, email, website FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ordinal) AS n FROM leads) WHERE n = 1")
def lead_dedupe_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_leads(_leads(spark, sf_dir), "email", "ordinal").select("ordinal", "email", "website")


@query(f"WITH {_LEADS} SELECT ordinal, email, website FROM (SELECT *, row_number() OVER (PARTITION BY email, lower(website) ORDER BY ordinal) AS n FROM leads) WHERE n = 1")
def lead_dedupe_email_website(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_leads(_leads(spark, sf_dir), "email_website", "ordinal").select("ordinal", "email", "website")


_SOURCES = """src AS (SELECT page_id % 4 AS source_rank, page_id AS ordinal, 'https://' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS url FROM pages)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return pages.select((F.col("page_id") % 4).alias("source_rank"), F.col("page_id").alias("ordinal"), F.concat(F.lit("https://"), urls.authority(F.col("url"))).alias("url"))


@query(
    f"""WITH {_SOURCES}, t AS (SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY ordinal) AS turn FROM src)
SELECT source_rank, ordinal, url, turn FROM (SELECT *, row_number() OVER (PARTITION BY rtrim(lower(url), '/') ORDER BY turn, source_rank) AS n FROM t) WHERE n = 1 ORDER BY turn, source_rank LIMIT 30"""
)
def round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.round_robin(_results(spark, sf_dir), 30).withColumn("turn", F.col("turn").cast("long"))


@query(f"WITH {_SOURCES} SELECT source_rank, ordinal, url FROM (SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY ordinal) AS n FROM src) WHERE n <= 10")
def source_cap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.per_group(_results(spark, sf_dir), "source_rank", 10, "ordinal")


@query(f"WITH {_LEADS} SELECT ordinal, email FROM leads WHERE NOT ({_OPT})")
def suppression_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept.not_suppressed(_leads(spark, sf_dir), _entries(spark, OPT_OUT)).select("ordinal", "email")


@query(f"WITH {_LEADS} SELECT ordinal, email FROM leads WHERE NOT ({_LED})")
def lead_ledger_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept.in_ledger(_leads(spark, sf_dir), _entries(spark, LEDGER)).filter(~F.col("known")).select("ordinal", "email")


@query(f"WITH {_LEADS} SELECT DISTINCT unnest([email, '@' || domain]) AS entry FROM leads WHERE NOT ({_OPT})")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept.ledger_entries(accept.not_suppressed(_leads(spark, sf_dir), _entries(spark, OPT_OUT)))


_SITES = ("tionsh.example.net", "WWW.example.org")


@query(
    f"""SELECT page_id, url FROM pages WHERE {_HOST.format('url')} <> 'tionsh.example.net'
  AND rtrim(lower(url), '/') NOT IN (SELECT rtrim(lower(url), '/') FROM pages WHERE page_id % 10 = 3)"""
)
def site_ledger_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results neither crawled nor of a known site: pages as results, every tenth crawled before."""
    pages = _read(spark, sf_dir, "pages")
    none = {c: F.lit("") for c in ("title", "directory_email", "directory_source_url")}
    key = urls.crawl_key(F.col("url"), F.lit(""), F.lit(""), F.lit(""))
    crawled = pages.filter("page_id % 10 = 3").select(key.alias("key"))
    return accept.pending(pages.withColumns(none), crawled, _entries(spark, _SITES)).select("page_id", "url")


def _verdict_sql(ledger: bool) -> str:
    known = _LED if ledger else "false"
    group = "domain" if ledger else "email"
    late = "known" if ledger else "duplicate"
    return f"""WITH {_LEADS},
flagged AS (SELECT *, ({_OPT}) AS s, ({known}) AS k FROM leads),
v AS (SELECT *, row_number() OVER (PARTITION BY {group}, s OR k ORDER BY ordinal, email, website) AS n FROM flagged),
verdicts AS (SELECT *, CASE WHEN s THEN 'suppressed' WHEN k THEN 'known' WHEN n = 1 THEN 'accepted' ELSE '{late}' END AS verdict FROM v)"""


def _verdicts(spark: SparkSession, sf_dir: str, ledger: bool) -> DataFrame:
    return accept.verdicts(_leads(spark, sf_dir), _entries(spark, OPT_OUT), _entries(spark, LEDGER) if ledger else None)


@query(_verdict_sql(False) + " SELECT ordinal, email, verdict FROM verdicts")
def accept_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, False).select("ordinal", "email", "verdict")


@query(_verdict_sql(True) + " SELECT ordinal, email, verdict FROM verdicts")
def accept_verdict_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir, True).select("ordinal", "email", "verdict")


_STATS = """ SELECT count(*) FILTER (verdict = 'accepted') AS leads_found, count(*) FILTER (verdict = 'accepted' AND consent_status = 'business_public') AS business_leads,
  count(*) FILTER (verdict = 'accepted' AND consent_status <> 'business_public') AS personal_leads, count(*) FILTER (verdict = 'duplicate') AS duplicates_skipped,
  count(*) FILTER (verdict = 'suppressed') AS suppressed_skipped, count(*) FILTER (verdict = 'known') AS known_skipped,
  count(DISTINCT company_name) FILTER (verdict = 'accepted') AS unique_domains FROM verdicts"""


@query(_verdict_sql(False) + _STATS)
def lead_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.lead_stats(_verdicts(spark, sf_dir, False))


@query(_verdict_sql(True) + _STATS)
def lead_stats_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.lead_stats(_verdicts(spark, sf_dir, True))


@query(f"WITH {_LEADS} SELECT consent_status, count(*) AS leads FROM leads GROUP BY 1")
def leads_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_status(_leads(spark, sf_dir))


@query(f"WITH {_LEADS} SELECT domain, count(*) AS leads, count(DISTINCT email) AS addresses FROM leads GROUP BY 1")
def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _leads(spark, sf_dir).withColumn("domain", text.email_domain(F.col("email")))
    return own.groupBy("domain").agg(F.count("*").alias("leads"), F.count_distinct("email").alias("addresses"))


@query(
    _verdict_sql(False)
    + f""", s AS (SELECT site_ordinal, count(*) AS n FROM verdicts WHERE verdict = 'accepted' GROUP BY 1),
p AS (SELECT site_ordinal, coalesce(sum(n) OVER (ORDER BY site_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM s)
SELECT ordinal, email FROM verdicts JOIN p USING (site_ordinal) WHERE verdict = 'accepted' AND p < {MAX_LEADS}"""
)
def max_leads_site_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = _verdicts(spark, sf_dir, False).filter("verdict = 'accepted'")
    return accept.cap_by_site(accepted, MAX_LEADS).select("ordinal", "email")


@query(
    f"""WITH {_LEADS}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ordinal) AS n FROM leads) WHERE n = 1 ORDER BY ordinal LIMIT {MAX_LEADS})
SELECT ordinal, email FROM d WHERE NOT ({_OPT})"""
)
def batch_cap_then_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept.batch_cap(_leads(spark, sf_dir), _entries(spark, OPT_OUT), MAX_LEADS, "ordinal").select("ordinal", "email")


@query(
    """WITH t AS (SELECT *, CASE WHEN turn % 3 = 0 THEN text ELSE '' END AS title FROM conversations)
SELECT conv_id, turn, coalesce(last_value(nullif(title, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'start') AS page_title FROM t"""
)
def title_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last title so far, seeded: turns of a conversation as a site's pages, every third of which has one."""
    own = _read(spark, sf_dir, "conversations").withColumn("title", F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(""))
    return own.select("conv_id", "turn", crawl.carried_title(F.lit("start"), F.col("title"), Window.partitionBy("conv_id").orderBy("turn", "text")).alias("page_title"))


@query(
    f"""WITH {_MAILS}, s AS (SELECT source AS site, doc_id AS visit, email FROM mails)
SELECT site, email, min(visit) AS visit FROM s GROUP BY 1, 2"""
)
def site_email_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a site that has an address first: documents as their source's pages."""
    own = _read(spark, sf_dir, "documents").select(F.col("source").alias("site"), F.col("doc_id").alias("visit"), F.explode(text.emails(F.coalesce("text", F.lit("")))).alias("email"))
    return dedupe.first_wins(own, F.concat_ws("\t", "site", "email"), "visit").select("site", "email", "visit")


#: A robots file that every other host of the pages is taken to have: French pages are closed but for the ones that end in a slash.
ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /fr/1\nDisallow: /fr/\nDisallow: /es"


_CRAWLED = f"""{_PAGE_MAILS}, h AS (SELECT *, {_HOST.format("url")} AS host FROM pages),
o AS (SELECT *, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM h),
a AS (SELECT * FROM o WHERE length(host) % 2 = 1 OR starts_with(path, '/fr/1') OR NOT (starts_with(path, '/fr/') OR starts_with(path, '/es'))),
s AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM o),
crawled AS (SELECT page_id, s.url AS source_url, regexp_replace(s.url, '#.*$', '') AS website, email, company AS company_name, title, {_CLASS} AS consent_status
  FROM s JOIN (SELECT DISTINCT url FROM a) USING (url) JOIN page_mails USING (page_id) JOIN ({_TITLES}) USING (page_id) WHERE n = 1)"""


def _starts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first page of each host as a search result, all pages as snapshots, and robots files of every other host."""
    own = _read(spark, sf_dir, "pages").withColumn("host", urls.host(F.col("url")))
    none = (F.lit("").alias(c) for c in ("title", "snippet", "directory_email", "directory_source_url"))
    starts = dedupe.first_wins(own, F.col("host"), "page_id").select("url", *none, F.col("page_id").alias("ordinal"))
    return starts, own.select("url", "html"), own.filter(F.length("host") % 2 == 0).select("host", F.lit(ROBOTS).alias("text")).distinct()


@query(f"WITH {_CRAWLED} SELECT source_url, website, email, company_name, consent_status FROM crawled")
def site_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of a crawl over the pages as snapshots, under robots rules: the first page of each host, then what its contact links and guesses reach."""
    return crawl.crawl(*_starts(spark, sf_dir), "hotel", include_personal=True).select("source_url", "website", "email", "company_name", "consent_status")


@query(
    f"""WITH {_CRAWLED}, j AS (SELECT *, regexp_replace(email, '^[^@]*@', '') AS domain FROM crawled WHERE page_id % 7 <> 3 AND {_HOST.format("source_url")} <> 'tionsh.example.net'),
w AS (SELECT *, ({_OPT}) AS s FROM j),
v AS (SELECT *, row_number() OVER (PARTITION BY domain, s ORDER BY page_id, email) AS n FROM w),
k AS (SELECT page_id, coalesce(sum(count(*)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v WHERE NOT s AND n = 1 GROUP BY 1)
SELECT page_id AS ordinal, email, website, title AS page_title FROM v JOIN k USING (page_id) WHERE NOT s AND n = 1 AND before < 4"""
)
def discover_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run: results, sites of earlier runs left out, the crawl under robots rules, opt-outs, one lead per domain, at most four and those of the last site."""
    starts, pages, robots = _starts(spark, sf_dir)
    crawled = starts.filter("ordinal % 7 = 3").select(urls.crawl_key(F.col("url"), F.lit(""), F.lit(""), F.lit("")).alias("key"))
    ledger = _entries(spark, ("@none.example",))
    judged = discover.judged(starts, pages, robots, _entries(spark, OPT_OUT), "hotel", ledger, _entries(spark, _SITES), crawled, include_personal=True)
    return discover.discover(judged, 4).select("ordinal", "email", "website", "page_title")
