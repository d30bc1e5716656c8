"""Queries of files, ledgers, states and searches that a run reads and writes, each made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import sinks
from gleaner.functions import errors, text, urls
from gleaner.lineage import new_folder
from gleaner.operators import accept, crawl
from gleaner.plans import planning
from gleaner.queries import core
from gleaner.queries.core import _read
from gleaner.queries.fixtures import _each, _over
from gleaner.schema import label
from gleaner.sources import providers, search, snapshots
from gleaner.state import RunState, baseline
from gleaner.streaming import accepting, running

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def _i(name: str) -> F.Column:
    return F.col(name).cast("string")


def _lines(spark: SparkSession, sf_dir: str, line) -> str:
    """A text file of a line a customer: every tenth is a comment, every tenth is blank."""
    path = new_folder(spark, "lines")
    own = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit(" # "), line)).when(F.col("c_custkey") % 10 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), line, F.lit(" ")))
    _read(spark, sf_dir, "customer").select(own.alias("value")).write.text(path)
    return path


_HELD = "c_custkey % 10 > 1"


@query(f"SELECT 'https://c' || c_custkey || '.example' AS url, 'https://c' || c_custkey || '.example' AS title FROM customer WHERE {_HELD}")
def seed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines(spark, sf_dir, F.concat(F.lit("https://c"), _i("c_custkey"), F.lit(".example")))
    return providers.seeds(spark, path).select("url", "title")


@query(f"SELECT c_name AS term FROM customer WHERE {_HELD}")
def term_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.terms(spark, _lines(spark, sf_dir, F.col("c_name")))


@query(f"SELECT DISTINCT '@mail' || (c_custkey % 40) || '.example.com' AS entry FROM customer WHERE {_HELD}")
def suppression_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines(spark, sf_dir, F.concat(F.lit("@Mail"), (F.col("c_custkey") % 40).cast("string"), F.lit(".EXAMPLE.com")))
    return accept.lines(spark.read.text(path))


@query("SELECT DISTINCT unnest(['info@s' || s_suppkey % 60 || '.example', '@s' || s_suppkey % 60 || '.example']) AS entry FROM supplier WHERE s_nationkey < 20")
def ledger_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that two runs add to, whose leads overlap."""
    leads = _read(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("info@S"), (F.col("s_suppkey") % 60).cast("string"), F.lit(".example")).alias("email"))
    path = new_folder(spark, "ledger")
    sinks.append_ledger(leads.filter("s_nationkey < 12"), path)
    sinks.append_ledger(leads.filter("s_nationkey between 8 and 19"), path)
    return sinks.read_ledger(spark, path)


@query(
    """SELECT 'search_results' AS part, count(*) AS rows FROM supplier UNION ALL SELECT 'crawled', count(*) FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'leads', count(*) FROM customer
UNION ALL SELECT 'completed_plans', count(*) FROM nation UNION ALL SELECT 'completed_locations', 0"""
)
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's state in two commits, the second played twice, read by a run that goes on."""
    own = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("https://s"), _i("s_suppkey"), F.lit(".example")).alias("url"), "s_suppkey")
    state = RunState(spark, new_folder(spark, "state"))
    state.begin(category="hotel", limit=10)
    state.append_all({"search_results": own, "completed_plans": _read(spark, sf_dir, "nation").select("n_name")}, "search")
    for _ in range(2):
        state.append_all({"crawled": own.filter("s_suppkey % 2 = 0").select("url"), "leads": _read(spark, sf_dir, "customer").select(F.col("c_name").alias("email"))}, "crawl")
    again = RunState(spark, state.path)
    again.begin(category="hotel", limit=10)
    return spark.createDataFrame(list(again.counts().items()), "part string, rows long")


@query(f"WITH {core._LEADS} SELECT count(*) AS leads_found, count(*) FILTER (consent_status = 'business_public') AS business_leads, count(*) FILTER (consent_status <> 'business_public') AS personal_leads FROM leads")
def resumed_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that a resumed run starts from."""
    return baseline(core._leads(spark, sf_dir))


@query("SELECT s_name AS title, 'https://s' || s_suppkey || '.example' AS url FROM supplier WHERE s_nationkey >= 5 AND s_nationkey % 3 <> 2")
def directory_search_goes_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory pages of nations as locations, the first page of each, without the locations that an earlier run completed."""
    i = _i("s_suppkey")
    item = F.concat(F.lit("<article class='search-result-article'><a class=\"title-link\" href=\"/w"), i, F.lit('"><h3>'), F.col("s_name"), F.lit("</h3></a><a class='kontaktinfo-web-click' href='https://s"), i, F.lit(".example'>x</a></article>"))
    own = _read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(item), "").alias("html"))
    location = F.concat(F.lit("n"), _i("s_nationkey"))
    pages = own.select(F.lit("wko").alias("scraper_key"), F.concat(F.lit("l"), location).alias("url"), "html", F.when(F.col("s_nationkey") % 3 == 2, 2).otherwise(1).alias("page"), location.alias("location"))
    done = own.filter("s_nationkey < 5").select(location.alias("location"))
    return search.directory_search(pages, spark.createDataFrame([], "url string, html string"), 1_000_000, done, "fast").select("title", "url")


@query(
    """WITH s AS (SELECT s_suppkey % 17 AS domain_rank, s_suppkey AS ordinal, 'https://x' || (s_suppkey // 34) || '.example' AS url FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY domain_rank ORDER BY ordinal) AS n FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY domain_rank, ordinal) AS k FROM r WHERE n <= 6)
SELECT domain_rank, ordinal, url FROM f WHERE k = 1 ORDER BY domain_rank, ordinal LIMIT 100"""
)
def source_domain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches narrowed to source domains: a share of the limit each, first of each address."""
    n = F.col("s_suppkey")
    own = _read(spark, sf_dir, "supplier").select((n % 17).alias("domain_rank"), n.alias("ordinal"), F.concat(F.lit("https://x"), F.floor(n / 34).cast("string"), F.lit(".example")).alias("url"))
    return search.site_rows(own, 100).select("domain_rank", "ordinal", "url")


@query(f"SELECT url, length(html) AS n_chars FROM pages WHERE page_id % 4 NOT IN (1, 2) AND NOT (length({core._HOST.format('url')}) % 3 = 0 AND page_id IS NOT NULL)")
def readable_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of fetched pages those that are HTML, came back, and are open by their hosts' robots files."""
    pages = _read(spark, sf_dir, "pages")
    kind = F.when(F.col("page_id") % 4 == 1, "application/pdf").otherwise("Text/HTML; charset=utf-8")
    status = F.when(F.col("page_id") % 4 == 2, 404).when(F.col("page_id") % 4 == 3, 200)
    host = urls.host(F.col("url"))
    robots = pages.select(host.alias("host")).distinct().filter("length(host) % 3 = 0").withColumn("text", F.lit("User-agent: *\nDisallow: /"))
    own = snapshots.readable(pages.select("url", kind.alias("content_type"), status.alias("status"), "html"), robots)
    return own.select("url", F.length("html").alias("n_chars"))


PLACES = [("Wien {i}", True), ("{i} Österreich", True), ("Salzburg-{i}", True), ("Berlin {i}", False), ("Sankt {i}", False), ("AT{i}", False)]


@query(_each(PLACES, "location, austrian"))
def austrian_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, [(x,) for x, _ in PLACES], "location string").select("location", text.is_austrian(F.col("location")).alias("austrian"))


@query(f"SELECT * FROM ({core.ORACLES['site_crawl']}) WHERE consent_status = 'business_public'")
def site_crawl_without_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl that leaves out personal addresses, as it does by default."""
    return crawl.crawl(*core._starts(spark, sf_dir), "hotel").select("source_url", "website", "email", "company_name", "consent_status")


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Map ' ELSE 'Place ' END || s_suppkey AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'https://map' ELSE 'https://place' END || s_suppkey || '.example' AS url FROM supplier")
def map_database_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements of each target, and the place search for targets that have none."""
    i = F.concat(_i("s_suppkey"))
    own = _read(spark, sf_dir, "supplier")
    tags = F.concat(F.lit('{"elements":['), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"tags":{"name":"Map '), i, F.lit('","website":"https://map'), i, F.lit('.example"}}'))).otherwise('{"tags":{"name":"no site"}}'), F.lit("]}"))
    places = F.concat(F.lit('[{"name":"Place '), i, F.lit('","extratags":{"website":"https://place'), i, F.lit('.example"}}]'))
    elements, found = (own.select(F.col("s_suppkey").alias("response"), c.alias("payload")) for c in (tags, places))
    return providers.osm_with_fallback(elements, found).select("title", "url")


@query("SELECT c_mktsegment AS category, 'info@' || c_custkey || '.example' AS email FROM customer")
def csv_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of leads into CSV folders, a batch each; started again, it adds nothing."""
    own = running.file_stream(spark, f"{sf_dir}/customer.parquet", "c_custkey long, c_mktsegment string")
    none = {c: F.lit("") for c in ("company_name", "website", "source_url", "page_title", "consent_status")}
    leads = own.select(F.col("c_mktsegment").alias("category"), F.concat(F.lit("info@"), _i("c_custkey"), F.lit(".example")).alias("email")).withColumns(none)
    path = new_folder(spark, "csv-stream")
    for _ in range(2):
        accepting.write_stream(leads, f"{path}/rows", f"{path}/log").awaitTermination()
    return spark.read.option("header", True).csv(f"{path}/rows").select("category", "email")


@query(
    """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'https://s' || s_suppkey || '.example' WHEN 1 THEN 'info@s' || s_suppkey || '.example' WHEN 2 THEN s_name WHEN 3 THEN 'list' || s_nationkey ELSE 'Branchenverzeichnis' END AS label FROM supplier"""
)
def result_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What results are called, of which each fifth has an address, a directory address, a title, a listing, or nothing."""
    way = F.col("s_suppkey") % 5
    i = _i("s_suppkey")
    own = _read(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(way == 0, F.concat(F.lit("https://s"), i, F.lit(".example"))).otherwise(" ").alias("url"), F.when(way <= 1, F.concat(F.lit("info@s"), i, F.lit(".example"))).otherwise("").alias("directory_email"),
        F.when(way <= 2, F.col("s_name")).alias("title"), F.when(way <= 3, F.concat(F.lit("list"), _i("s_nationkey"))).otherwise("").alias("directory_source_url"),
    )
    return own.select("s_suppkey", label().alias("label"))


@query(
    f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'HTTP Error ' || (500 + user_id % 5) || ': ' || event_type WHEN 1 THEN 'SSL: ' || event_type || '. {errors.CERTIFICATE_HELP.replace("'", "''")}'
  WHEN 2 THEN 'reset by ' || event_type ELSE props END AS message FROM events"""
)
def formatted_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of a fetch log: answers, certificates, other reasons, bare messages."""
    way = F.col("event_id") % 4
    reason = F.when(way == 0, F.col("event_type")).when(way == 1, F.concat(F.lit("SSL: "), "event_type")).when(way == 2, F.concat(F.lit("reset by "), "event_type"))
    status = F.when(way == 0, 500 + F.col("user_id") % 5)
    return _read(spark, sf_dir, "events").select("event_id", errors.formatted(status, reason, F.col("props")).alias("message"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 300 <= 30 THEN 90 WHEN c_custkey % 300 <= 150 THEN 40 ELSE 10 END AS depth,
  CASE WHEN c_custkey % 300 = 0 THEN 25 ELSE greatest(10, least(60, c_custkey * 7 // (c_custkey % 300) + 5)) END AS places,
  least(c_custkey * 7, greatest(100, CAST(ceil(c_custkey * 7 / greatest(1, c_custkey % 300)) AS INT))) AS per_location,
  least(120, greatest(10, CAST(ceil(greatest(1, ceil(c_custkey * 7 / greatest(1, c_custkey % 300))) / greatest(1, c_custkey % 9)) AS INT))) AS per_source FROM customer"""
)
def limit_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How limits are shared out: depths by plans, places by city, rows by location and by source."""
    n, limit = F.col("c_custkey") % 300, F.col("c_custkey") * 7
    own = _read(spark, sf_dir, "customer")
    return own.select(
        "c_custkey", planning.page_depth_of(n, F.col("c_custkey") % 2 == 1).alias("depth"), planning.places_per_city_of(limit, n).alias("places"),
        planning.per_location_limit_of(limit, n).alias("per_location"), planning.per_source_limit_of(limit, n, F.col("c_custkey") % 9).alias("per_source"),
    )
