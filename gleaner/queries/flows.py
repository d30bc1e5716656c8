"""Queries of streams, paging, walks, the map chain, live figures and resumable runs, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.lineage import new_folder
from gleaner.operators import live
from gleaner.operators.stats import per_minute
from gleaner.sinks import write_csv, write_json_array
from gleaner.sources import directories, nested, providers, search
from gleaner.state import RunState, run_plans
from gleaner.streaming import accepting, running, stall

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Seconds without an event after which a user's site is closed.
SILENT = 36 * 3600
PATIENCE, MOST_OFFSET, MOST_PAGES = 2, 150, 20


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS gap FROM e),
c AS (SELECT user_id, min(ms) FILTER (WHERE gap > {SILENT * 1000}) AS late_from, max(ms) AS last FROM g GROUP BY user_id),
v AS (SELECT g.*, c.late_from, c.last FROM g JOIN c USING (user_id))
SELECT CAST(user_id AS VARCHAR) AS site, event_id AS result, ms AS at_ms, CASE WHEN ms >= late_from THEN 'late' ELSE 'on_time' END AS verdict FROM v
UNION ALL SELECT CAST(user_id AS VARCHAR), NULL, max(ms) + {SILENT * 1000}, 'evicted' FROM v WHERE late_from IS NULL OR ms < late_from GROUP BY user_id
HAVING any_value(late_from) IS NOT NULL OR max(ms) + {SILENT * 1000} <= (SELECT max(ms) FROM e)"""
)
def silent_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of results that closes a silent site by a timer, and discards what comes later."""
    events = running.file_stream(spark, f"{sf_dir}/events.parquet", "event_id long, ts timestamp, user_id long")
    return running.drained(stall.watched(events, "user_id", "event_id", "ts", SILENT), "silent")


_ITEMS = """items AS (SELECT l_suppkey AS query, (n - 1) // 10 AS page, (n - 1) % 10 AS ordinal, l_partkey % 60 AS key FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem))"""


def _paged_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each supplier is a query, whose items come ten a page in the order of the sales."""
    own = _read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    items = own.select(F.col("l_suppkey").alias("query"), place.alias("n"), (F.col("l_partkey") % 60).alias("key"))
    items = items.select("query", F.floor(F.col("n") / 10).alias("page"), (F.col("n") % 10).alias("ordinal"), "key")
    return items, items.select("query", "page", (F.col("page") * 10).alias("offset")).distinct()


@query(
    f"""WITH {_ITEMS}, firsts AS (SELECT query, key, min(page) AS page FROM items GROUP BY 1, 2), news AS (SELECT query, page, count(*) AS n FROM firsts GROUP BY 1, 2),
pages AS (SELECT DISTINCT query, page FROM items), marked AS (SELECT p.*, n.n IS NULL AS stale, row_number() OVER (PARTITION BY p.query ORDER BY p.page) AS place FROM pages p LEFT JOIN news n USING (query, page)),
islands AS (SELECT *, place - row_number() OVER (PARTITION BY query, stale ORDER BY page) AS island FROM marked),
runs AS (SELECT *, row_number() OVER (PARTITION BY query, stale, island ORDER BY page) AS run FROM islands),
stops AS (SELECT query, min(page) AS stop FROM runs WHERE (stale AND run >= {PATIENCE}) OR page * 10 > {MOST_OFFSET} OR place > {MOST_PAGES} GROUP BY 1),
kept AS (SELECT i.* FROM items i LEFT JOIN stops s USING (query) WHERE stop IS NULL OR page < stop)
SELECT query, key, min(struct_pack(page := page, ordinal := ordinal)).page AS page, min(struct_pack(page := page, ordinal := ordinal)).ordinal AS ordinal FROM kept GROUP BY 1, 2"""
)
def paged_with_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paging that ends after two pages in a row without news, an offset or a number of pages."""
    items, pages = _paged_items(spark, sf_dir)
    return search.paged(items, pages, "query", F.col("key"), PATIENCE, MOST_OFFSET, MOST_PAGES).select("query", "key", "page", "ordinal")


_URL = "'https://maps.example/maps/place/' || page_id"


@query(
    f"""SELECT page_id, place, place_url FROM (SELECT page_id, {_URL} || '/top' AS u0, {_URL} || '/list' AS u1, {_URL} || '/deep?hl=de' AS u2 FROM pages), LATERAL (
  SELECT 0 AS place, u0 AS place_url UNION ALL SELECT 1, u1 UNION ALL SELECT 2, u2)"""
)
def nested_place_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place addresses at three depths of payloads made of the pages, each named twice, beside the pages' own texts and addresses."""
    url = F.concat(F.lit("https://maps.example/maps/place/"), F.col("page_id").cast("string"))
    deep = F.struct(F.array(F.struct(F.concat(url, F.lit("/deep?hl=de")).alias("href"), F.col("url").alias("source"))).alias("x"), F.length("html").alias("n"))
    payload = F.struct(
        F.concat(url, F.lit("/top")).alias("a"), F.array(F.lit("no place"), F.concat(url, F.lit("/list")), F.concat(url, F.lit("/LIST?x=1"))).alias("b"),
        F.struct(F.array(deep, deep).alias("inner"), F.substring("html", 1, 200).alias("text")).alias("c"),
    )
    own = _read(spark, sf_dir, "pages").select("page_id", F.to_json(payload).alias("payload"))
    return nested.place_addresses(own, "payload", "page_id").select("page_id", "place", "place_url")


@query("SELECT s_nationkey AS nation, s_name AS name, 'https://s' || s_suppkey || '.example' AS url FROM supplier WHERE s_suppkey % 5 <> 4")
def linked_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses of linked data, one document a nation, of its suppliers: in lists, graphs, item lists and result pages; persons aren't any."""
    kinds = F.array(*(F.lit(k) for k in (*nested.BUSINESSES[:4], "Person")))
    way = F.col("s_suppkey") % 5
    body = F.concat(F.lit('{"@type":"'), F.element_at(kinds, (way + 1).cast("int")), F.lit('","name":"'), F.col("s_name"), F.lit('","url":"https://s'), F.col("s_suppkey").cast("string"), F.lit('.example","parent":{"@type":"Hotel","name":"inner"}}'))
    around = (("{\"@graph\":[", "]}"), ("{\"@type\":\"ItemList\",\"itemListElement\":[{\"@type\":\"ListItem\",\"item\":", "}]}"), ("{\"@type\":\"FAQPage\",\"mainEntity\":", "}"), ("[[", "]]"))
    wrapped = body
    for k, (before, after) in enumerate(around):
        wrapped = F.when(F.col("s_acctbal").cast("long") % len(around) == k, F.concat(F.lit(before), body, F.lit(after))).otherwise(wrapped)
    own = _read(spark, sf_dir, "supplier").select("s_nationkey", wrapped.alias("w"))
    docs = own.groupBy(F.col("s_nationkey").alias("nation")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("w"), ","), F.lit("]")).alias("payload"))
    items = nested.businesses(docs, "payload", "nation")
    return items.select("nation", F.expr("variant_get(item, '$.name', 'string')").alias("name"), F.expr("variant_get(item, '$.url', 'string')").alias("url"))


def _map_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A listing for five suppliers each. By supplier, a place's page has a website, or the listing has it near the place, or nothing has; each fourth listing only has loose links."""
    own = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n"), F.floor(F.col("s_suppkey") / 5).alias("response"), F.col("s_suppkey").cast("string").alias("i"))
    place = F.concat(F.lit("https://www.google.com/maps/place/S"), "i", F.lit("/data"))
    link = F.concat(F.lit('<a class="hfpxzc" href="'), place, F.lit('">x</a>'), F.when(F.col("n") % 3 == 1, F.concat(F.lit('<i aria-label="Website: https://near'), "i", F.lit('.example">w</i>'))).otherwise(""), F.lit(" " * 1300))
    loose = F.concat(F.lit('<a href="https://loose'), "i", F.lit('.example">x</a>'))
    item = F.when(F.col("response") % 4 == 3, loose).otherwise(link)
    lists = own.groupBy("response").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("t")))), lambda x: x["t"]), "").alias("payload"))
    lists = lists.select("response", F.concat(F.lit("maps/search "), "payload").alias("payload"))
    site = F.when(F.col("n") % 3 == 0, F.concat(F.lit("https://own"), "i", F.lit(".example"))).otherwise("")
    details = own.filter("n % 3 <> 2 and response % 4 <> 3").select(place.alias("place_url"), F.to_json(F.struct(F.concat(F.lit("Wirt "), "i").alias("name"), site.alias("website"))).alias("payload"))
    return lists, details


@query(
    """SELECT s_suppkey // 5 AS response, CASE WHEN s_suppkey // 5 % 4 = 3 THEN 2 WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS step,
  CASE WHEN s_suppkey // 5 % 4 = 3 THEN 'loose' || s_suppkey || '.example' ELSE 'Wirt ' || s_suppkey END AS title,
  'https://' || CASE WHEN s_suppkey // 5 % 4 = 3 THEN 'loose' WHEN s_suppkey % 3 = 0 THEN 'own' ELSE 'near' END || s_suppkey || '.example' AS url
FROM supplier WHERE s_suppkey // 5 % 4 = 3 OR s_suppkey % 3 <> 2"""
)
def map_search_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places' pages, else the listing near the place, else its loose links."""
    return providers.map_search(*_map_pages(spark, sf_dir))[0].select("response", "step", "title", "url")


@query(
    """SELECT s_suppkey // 5 AS response, CASE WHEN s_suppkey // 5 % 4 = 3 THEN 'search_loaded_no_listings' ELSE 'listings_present' END AS page_class, count(*) FILTER (s_suppkey // 5 % 4 <> 3) AS place_urls,
  count(*) FILTER (s_suppkey // 5 % 4 <> 3 AND s_suppkey % 3 <> 2) AS details_checked, count(*) FILTER (s_suppkey // 5 % 4 <> 3 AND s_suppkey % 3 = 0) AS from_details,
  count(*) FILTER (s_suppkey // 5 % 4 <> 3 AND s_suppkey % 3 = 1) AS from_listing, count(*) FILTER (s_suppkey // 5 % 4 = 3) AS from_links FROM supplier GROUP BY 1, 2"""
)
def map_search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.map_search(*_map_pages(spark, sf_dir))[1]


@query(
    """SELECT count(*) AS rows, count(*) FILTER (event_type = 'click') AS accepted, round(count(*) FILTER (event_type = 'click') / ((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000) * 60, 1) AS accepted_per_minute,
  round(count(*) / ((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000) * 60, 1) AS rows_per_minute FROM events"""
)
def observed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that the writing job keeps, as rates over the events' time."""
    events = _read(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "accepted").otherwise("known").alias("verdict"), F.col("ts"))
    out, seen = live.observed(events, consent=None, at="ts")
    out.write.parquet(new_folder(spark, "observed"))
    got = seen.get
    seconds = (got["last_at"] - got["first_at"]).total_seconds() if got["rows"] else 0.0
    row = got["rows"], got["accepted"], per_minute(got["accepted"], seconds), per_minute(got["rows"], seconds)
    return spark.createDataFrame([row], "rows long, accepted long, accepted_per_minute double, rows_per_minute double")


@query("SELECT n_name AS location, s_name AS title FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def resumed_plan_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan a nation, answered by its suppliers, seven at once: a run that is stopped in its second block, and another that goes on."""
    suppliers = _read(spark, sf_dir, "supplier")
    plans = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("location"), F.col("n_nationkey").alias("nation"))
    state = RunState(spark, new_folder(spark, "run"))
    asked = []

    def answer(block: DataFrame) -> DataFrame:
        asked.append(block)
        if len(asked) == 2:
            raise InterruptedError
        return block.join(suppliers, F.col("nation") == F.col("s_nationkey")).select("location", F.col("s_name").alias("title"))

    try:
        run_plans(state, plans, ["location"], answer, at_once=7)
    except InterruptedError:
        run_plans(RunState(spark, state.path), plans, ["location"], answer, at_once=7)
    return state.read("search_results", "location string, title string")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def json_array_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers as one JSON array, joined of the tasks' parts, read back."""
    path = new_folder(spark, "array")
    own = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    write_json_array(own.repartition(8), path, "s_suppkey")
    return spark.read.schema(own.schema).option("multiLine", True).json(path)


@query(
    """SELECT c_mktsegment AS category, c_name AS company_name, 'info@' || c_custkey || '.example' AS email, 'https://' || c_custkey || '.example' AS website, 'list "' || c_nationkey || '", a' AS source_url,
  '' AS page_title, 'business_public' AS consent_status, 'one; two' AS notes FROM customer"""
)
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as leads in CSV files, read back."""
    i = F.col("c_custkey").cast("string")
    own = _read(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("category"), F.col("c_name").alias("company_name"), F.concat(F.lit("info@"), i, F.lit(".example")).alias("email"), F.concat(F.lit("https://"), i, F.lit(".example")).alias("website"),
        F.concat(F.lit('list "'), "c_nationkey", F.lit('", a')).alias("source_url"), F.lit("").alias("page_title"), F.lit("business_public").alias("consent_status"),
        F.array(F.lit("one"), F.lit("two")).alias("notes"), F.current_timestamp().alias("discovered_at"),
    )
    path = new_folder(spark, "csv")
    write_csv(own, path)
    return spark.read.option("header", True).option("escape", '"').option("nullValue", "\0").option("emptyValue", "").csv(path).drop("discovered_at").na.fill("")


@query(
    """SELECT 'yelp' AS scraper_key, s_suppkey // 50 AS page, s_suppkey % 50 AS place, 'Wirt ' || s_suppkey AS name, 'https://www.yelp.de/biz/wirt-' || s_suppkey AS detail_url FROM supplier"""
)
def listing_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of fifty suppliers, whose rows a table function gives one by one."""
    own = _read(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.col("s_suppkey") / 50).alias("page"))
    link = F.struct("s_suppkey", F.concat(F.lit('<a href="/biz/wirt-'), "s_suppkey", F.lit('?osq=x">x</a>')).alias("t"))
    pages = own.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(link)), lambda x: x["t"]), "").alias("html"))
    pages = pages.select(F.lit("yelp").alias("scraper_key"), "page", F.concat(F.lit("list/"), "page").alias("url"), "html")
    rows = directories.listed_rows(pages)
    return rows.select("scraper_key", F.shiftright("ordinal", 32).alias("page"), F.col("ordinal").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"), "name", "detail_url")


@query("SELECT DISTINCT 'user' || user_id || '@' || event_type || '.example' AS email FROM events")
def deduplicated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of leads, one an address."""
    events = running.file_stream(spark, f"{sf_dir}/events.parquet", "user_id long, event_type string")
    leads = events.select(F.concat(F.lit("user"), "user_id", F.lit("@"), "event_type", F.lit(".example")).alias("email"))
    return running.drained(accepting.dedupe_stream(leads), "deduplicated")


@query(
    """WITH l AS (SELECT event_id AS ordinal, 'user' || event_id || '@site' || user_id || '.example' AS email, user_id FROM events WHERE user_id % 7 NOT IN (1, 2))
SELECT ordinal, email, CASE WHEN ordinal = min(ordinal) OVER (PARTITION BY user_id) THEN 'accepted' ELSE 'known' END AS verdict FROM l"""
)
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of leads against an opt-out list and a ledger: the first of a domain closes it."""
    events = running.file_stream(spark, f"{sf_dir}/events.parquet", "event_id long, user_id long").filter("user_id is not null")
    leads = events.select(F.col("event_id").alias("ordinal"), F.concat(F.lit("user"), "event_id", F.lit("@site"), "user_id", F.lit(".example")).alias("email"))
    domains = _read(spark, sf_dir, "events").select("user_id").distinct().withColumn("entry", F.concat(F.lit("@site"), "user_id", F.lit(".example")))
    return running.drained(accepting.ledger_stream(leads, domains.filter("user_id % 7 = 1"), domains.filter("user_id % 7 = 2")), "ledger")
