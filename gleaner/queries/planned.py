"""Queries of the planning operators: suppliers name categories and texts, nations places, customers towns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import tables
from gleaner.functions import text, urls
from gleaner.plans import planning
from gleaner.queries.core import _read
from gleaner.sources import search
from gleaner.tables import values_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


CATEGORIES = [(c,) for c in ("hotel", "Fitnessstudio", "kfz werkstatt", "IT Beratung", "immobilienmakler", "Goldschmied", "lager logistik", "Zahnarzt", " Café ", "")]
_NAMES = ", ".join(f"'{c}'" for (c,) in CATEGORIES)
#: A category a supplier: one of the ten, from the tenth on with the supplier's number.
_CAT = f"(SELECT [{_NAMES}][1 + s_suppkey % {len(CATEGORIES)}] || CASE WHEN s_suppkey < {len(CATEGORIES)} THEN '' ELSE ' ' || s_suppkey END AS category FROM supplier) t"
_MATCH = "(CASE WHEN length(keyword) <= 2 THEN regexp_matches(lower({0}), '(^|[^a-z0-9äöüß])' || keyword || '($|[^a-z0-9äöüß])') ELSE contains(lower({0}), keyword) END)"
_VARIANTS = values_sql(tables.variant_rows(), "rank, keyword, place, term")
_TAGS = values_sql(tables.osm_rows(), "rank, keyword, place, tag_key, tag_value")


def _numbered(spark: SparkSession, sf_dir: str, texts: list[tuple], *names: str) -> DataFrame:
    """A row a supplier: s_suppkey, i (its number as text) and one of these texts."""
    n = F.col("s_suppkey")
    each = F.array(*(F.struct(*(F.lit(v).cast("string").alias(k) for k, v in zip(names, row, strict=True))) for row in texts))
    own = _read(spark, sf_dir, "supplier").select("s_suppkey", n.cast("string").alias("i"), F.get(each, (n % len(texts)).cast("int")).alias("_t"))
    return own.select("s_suppkey", "i", "_t.*")


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _numbered(spark, sf_dir, CATEGORIES, "category")
    return own.select(F.when(F.col("s_suppkey") < len(CATEGORIES), F.col("category")).otherwise(F.concat_ws(" ", "category", "i")).alias("category"))


def _one_of(texts: list[tuple], k: int = 0) -> str:
    """SQL: a supplier's text."""
    quoted = ", ".join("NULL" if t[k] is None else f"'{t[k]}'" for t in texts)
    return f"[{quoted}][1 + s_suppkey % {len(texts)}]"


@query(f"SELECT category, n_name AS location FROM {_CAT}, nation")
def query_plan_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.cross_plan(_categories(spark, sf_dir), _read(spark, sf_dir, "nation").select(F.col("n_name").alias("location")))


@query(f"SELECT category, '' AS location FROM {_CAT}")
def query_plan_no_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.cross_plan(_categories(spark, sf_dir), spark.createDataFrame([], "location string"))


@query(
    f"""WITH c AS (SELECT DISTINCT trim(category) AS category FROM {_CAT} WHERE trim(category) <> ''), v AS (SELECT * FROM {_VARIANTS}),
best AS (SELECT category, rank FROM (SELECT category, rank, row_number() OVER (PARTITION BY category ORDER BY length(keyword) DESC, rank) AS n FROM c JOIN v ON place = 0 AND {_MATCH.format('category')}) WHERE n = 1)
SELECT category, place, term FROM best JOIN v USING (rank) UNION ALL SELECT category, 0, category FROM c WHERE category NOT IN (SELECT category FROM best)"""
)
def category_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.category_variants(_categories(spark, sf_dir))


@query(
    f"""WITH c AS (SELECT DISTINCT category FROM {_CAT} WHERE trim(category) <> ''),
m AS (SELECT category, '["' || tag_key || CASE WHEN tag_value = '' THEN '"]' ELSE '"="' || tag_value || '"]' END AS selector, min(rank * 100 + t.place) AS pos
  FROM c JOIN {_TAGS} ON {_MATCH.format('category')} GROUP BY 1, 2)
SELECT category, row_number() OVER (PARTITION BY category ORDER BY pos) - 1 AS place, selector FROM m
UNION ALL SELECT category, 0, '["name"~"' || trim(category) || '",i]' FROM c WHERE category NOT IN (SELECT category FROM m)"""
)
def osm_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.osm_selectors(_categories(spark, sf_dir).filter("trim(category) <> ''")).withColumn("place", F.col("place").cast("long"))


@query(
    f"""WITH c AS (SELECT DISTINCT category FROM {_CAT} WHERE regexp_matches(category, '^(hotel|IT Beratung|Zahnarzt)')),
m AS (SELECT category, 'nwr["' || tag_key || '"="' || tag_value || '"](area.searchArea);' AS line, min(rank * 100 + t.place) AS pos FROM c JOIN {_TAGS} ON {_MATCH.format('category')} GROUP BY 1, 2)
SELECT category, '[out:json][timeout:35];' || chr(10) || 'area["name"~"^Bad Aibling\\.$",i]["boundary"="administrative"]->.searchArea;' || chr(10) || '(' || chr(10)
  || string_agg(line, chr(10) ORDER BY pos) || chr(10) || ');' || chr(10) || 'out tags center 500;' AS query FROM m GROUP BY 1"""
)
def overpass_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _categories(spark, sf_dir).filter(F.col("category").rlike("^(hotel|IT Beratung|Zahnarzt)"))
    return planning.overpass_queries(some, " Bad Aibling. ", 50)


def _towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as named places with populations as text: names repeat, some are small, some no numbers."""
    c = _read(spark, sf_dir, "customer")
    country = F.when(F.col("c_nationkey") % 3 == 0, "AT").otherwise("DE")
    people = F.when(F.col("c_custkey") % 11 == 0, "unknown").otherwise(F.concat((F.col("c_custkey") * 37 % 90).cast("string"), F.lit("."), F.lpad((F.col("c_custkey") * 91 % 1000).cast("string"), 3, "0")))
    return c.select(country.alias("country"), F.concat(F.lit("Ort "), (F.col("c_custkey") % 400).cast("string")).alias("name"), people.alias("population"))


_TOWNS = """towns AS (SELECT CASE WHEN c_nationkey % 3 = 0 THEN 'AT' ELSE 'DE' END AS country, 'Ort ' || (c_custkey % 400) AS name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey * 37 % 90 * 1000 + c_custkey * 91 % 1000 END AS population FROM customer),
best AS (SELECT country, name, max(population) AS population FROM towns WHERE population >= 5000 GROUP BY 1, 2),
cities AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY population DESC, name) AS rank FROM best)"""


@query(f"WITH {_TOWNS} SELECT country, name, population, rank FROM cities")
def city_best_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.best_cities(_towns(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_TOWNS} SELECT country, name, rank FROM cities WHERE rank <= 12")
def city_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.top_cities(planning.best_cities(_towns(spark, sf_dir)), 12).select("country", "name", F.col("rank").cast("long").alias("rank"))


_ORDER = "(CASE country WHEN 'DE' THEN 0 ELSE 1 END)"
_LABELS = "(VALUES ('DE', 'Deutschland'), ('AT', 'Österreich')) l(country, label)"


@query(
    f"""WITH {_TOWNS}
SELECT 0 AS part, {_ORDER} AS country_rank, 0 AS place, 'hotel ' || label || ' Unternehmen Kontakt E-Mail' AS query, country FROM {_LABELS}
UNION ALL SELECT 1, {_ORDER}, rank, 'hotel ' || name || ' Unternehmen Kontakt E-Mail', country FROM cities WHERE rank <= 60"""
)
def expand_query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.search_plans("hotel", "", planning.best_cities(_towns(spark, sf_dir)), ("DE", "AT"), limit=100)


@query(
    f"""WITH {_TOWNS}, b AS (SELECT unnest([0, 1]) AS place)
SELECT 0 AS part, {_ORDER} AS country_rank, place, 'hotel ' || label || CASE place WHEN 0 THEN ' Unternehmen Kontakt E-Mail' ELSE '' END AS query, country FROM {_LABELS}, b
UNION ALL SELECT 1, {_ORDER}, rank, 'hotel ' || name || ' Unternehmen Kontakt E-Mail', country FROM cities"""
)
def expanded_query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With expand: broad searches too, and all cities."""
    return planning.search_plans("hotel", "", planning.best_cities(_towns(spark, sf_dir)), ("DE", "AT"), limit=100, expand=True)


@query("SELECT 0 AS part, 0 AS country_rank, unnest([0, 1]) AS place, unnest(['hotel Wien Unternehmen Kontakt E-Mail', 'hotel Wien']) AS query, 'AT' AS country")
def location_query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given location stands for countries and cities."""
    return planning.search_plans("hotel", "Wien", planning.best_cities(_towns(spark, sf_dir)), ("AT",), limit=100, expand=True)


@query(f"SELECT 0 AS part, 0 AS country_rank, 0 AS place, place AS variant, term || ' Wien Unternehmen Kontakt E-Mail' AS query, 'AT' AS country FROM {_VARIANTS} WHERE keyword = 'software'")
def location_paid_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.synonym_plans("software", "Wien", planning.best_cities(_towns(spark, sf_dir)), ("AT",), limit=100)


@query(
    f"""WITH {_TOWNS}, v AS (SELECT place AS variant, term FROM {_VARIANTS} WHERE keyword = 'software')
SELECT 0 AS part, {_ORDER} AS country_rank, 0 AS place, variant, term || ' ' || label AS query, country FROM {_LABELS}, v
UNION ALL SELECT 1, {_ORDER}, rank, variant, term || ' ' || name, country FROM cities, v WHERE variant = 0 AND rank <= 800
UNION ALL SELECT 2, {_ORDER}, rank, variant, term || ' ' || name, country FROM cities, v WHERE variant > 0 AND rank <= 80"""
)
def paid_search_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.synonym_plans("software", "", planning.best_cities(_towns(spark, sf_dir)), ("DE", "AT"), limit=1000)


@query(f"SELECT category, domain_rank, category || ' site:' || domain AS query, 3 AS rows FROM {_CAT}, {values_sql(list(enumerate(tables.SOURCE_DOMAINS)), 'domain_rank, domain').replace(' t(', ' u(')}")
def site_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.site_searches(_categories(spark, sf_dir), 50)


@query(
    """WITH i AS (SELECT l_suppkey AS supplier, l_linenumber AS page, l_orderkey AS item, 'https://x.example/' || (l_partkey % 60) AS url FROM lineitem WHERE l_linenumber <> l_suppkey % 9),
p AS (SELECT supplier, unnest([1, 2, 3, 4, 5, 6, 7]) AS page FROM (SELECT DISTINCT supplier FROM i)),
f AS (SELECT supplier, url, min(page) AS page FROM i GROUP BY 1, 2),
t AS (SELECT supplier, min(page) AS stop FROM p ANTI JOIN f USING (supplier, page) GROUP BY 1)
SELECT supplier, page, item, url FROM i LEFT JOIN t USING (supplier) WHERE stop IS NULL OR page < stop"""
)
def paged_until_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of answers up to the first that is empty or without news: order lines as items, their numbers as pages."""
    own = _read(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") != F.col("l_suppkey") % 9)
    url = F.concat(F.lit("https://x.example/"), (F.col("l_partkey") % 60).cast("string"))
    items = own.select(F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("item"), url.alias("url"))
    pages = items.select("supplier").distinct().select("supplier", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"))
    return search.until_stale(items, pages, "supplier", urls.url_key(F.col("url")))


COUNTRY_LISTS = [("at;de",), ("",), ("DE,at, de",), ("fr",), (" At ",), (None,), ("xx;AT",)]


@query(
    f"""SELECT s_suppkey, raw, coalesce(nullif(list_aggregate(list_filter(list_transform(string_split(replace(coalesce(raw, ''), ';', ','), ','), lambda c: upper(trim(c))), lambda c, i: c IN ('DE', 'AT')
  AND list_position(list_transform(string_split(replace(raw, ';', ','), ','), lambda d: upper(trim(d))), c) = i), 'string_agg', ','), ''), 'DE') AS countries FROM (SELECT s_suppkey, {_one_of(COUNTRY_LISTS)} || ';' || s_suppkey AS raw FROM supplier)"""
)
def parse_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _numbered(spark, sf_dir, COUNTRY_LISTS, "raw").withColumn("raw", F.concat("raw", F.lit(";"), "i"))
    return own.select("s_suppkey", "raw", F.array_join(text.parse_countries(F.col("raw")), ",").alias("countries"))


@query(
    f"""SELECT n, CASE WHEN n >= 3000 THEN NULL WHEN n >= 1000 THEN 400 WHEN n >= 500 THEN 150 WHEN n >= 100 THEN 60 ELSE 40 END AS web, CASE WHEN n >= 3000 THEN NULL WHEN n >= 1000 THEN 800
  WHEN n >= 500 THEN 200 WHEN n >= 100 THEN 40 ELSE 12 END AS paid, CASE WHEN n >= 3000 THEN NULL WHEN n >= 1000 THEN 800 WHEN n >= 500 THEN 200 ELSE 40 END AS maps,
  CASE WHEN n >= 500 THEN NULL ELSE greatest(8, least(40, CAST(ceil(n / 3) AS INT))) END AS osm, CASE WHEN n >= 500 THEN 12 WHEN n >= 100 THEN 8 ELSE 4 END AS pages,
  greatest(1, CAST(ceil(n / 17) AS INT)) AS per_domain FROM (SELECT CASE WHEN c_custkey % 50 = 0 THEN 150000 ELSE c_custkey * 37 % 4000 END AS n FROM customer)"""
)
def city_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    limits = _read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 50 == 0, 150_000).otherwise(F.col("c_custkey") * 37 % 4000).cast("int").alias("n"))
    return limits.select(
        "n", planning.budget_of(n, planning.WEB_CITIES).alias("web"), planning.budget_of(n, planning.PAID_CITIES).alias("paid"), planning.budget_of(n, planning.MAP_CITIES).alias("maps"),
        planning.osm_budget_of(n).alias("osm"), planning.budget_of(n, planning.PAGES).alias("pages"), planning.per_domain_limit_of(n).alias("per_domain"),
    )


@query(
    f"""WITH {_TOWNS}, done AS (SELECT country, name FROM cities WHERE rank % 3 = 1) SELECT country, name FROM cities WHERE rank <= 30 AND (country, name) NOT IN (SELECT (country, name) FROM done)"""
)
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.operators.accept import without_completed

    cities = planning.best_cities(_towns(spark, sf_dir))
    return without_completed(planning.top_cities(cities, 30), cities.filter("rank % 3 = 1").select("country", "name"), "country", "name").select("country", "name")


SLUGS = [(x,) for x in ("Bad Aibling", "  köln   süd ", "Groß-Gerau", "frankfurt am Main", "hotel-garni mitte", "ÄRZTE", "a")]


@query(
    f"""WITH w AS (SELECT raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS v FROM (SELECT {_one_of(SLUGS)} || ' ort' || s_suppkey AS raw FROM supplier)),
p AS (SELECT raw, v, list_transform(string_split(v, ' '), lambda x: list_aggregate(list_transform(string_split(x, '-'), lambda y: upper(y[1]) || y[2:]), 'string_agg', '-')) AS parts FROM w)
SELECT raw, array_to_string(parts, ' ') AS title, array_to_string(parts, '-') AS slug, replace(replace(replace(replace(lower(array_to_string(parts, '-')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS folded FROM p"""
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    own = _numbered(spark, sf_dir, SLUGS, "raw").withColumn("raw", F.concat("raw", F.lit(" ort"), "i"))
    return own.select("raw", text.title_case(text.collapse(raw)).alias("title"), text.hyphen_slug(raw).alias("slug"), text.folded_slug(raw, "berlin").alias("folded"))


@query(
    f"""WITH {_TOWNS} SELECT country_rank, rank, name FROM (SELECT {_ORDER} AS country_rank, rank, name, row_number() OVER (PARTITION BY name ORDER BY {_ORDER}, rank) AS n FROM cities) WHERE n = 1"""
)
def city_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.city_names(planning.best_cities(_towns(spark, sf_dir)), ("DE", "AT")).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_TOWNS} SELECT {_ORDER} * 1000000 + rank AS place, name AS label FROM cities WHERE rank <= 40")
def map_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.locations(" ", planning.best_cities(_towns(spark, sf_dir)), ("DE", "AT"), planning.osm_budget(120))


ASKED = [("hotel", "Bad Aibling", "DE"), ("café & bar", "", "AT"), (" ", "", "DE"), ("müller", " Köln ", "AT")]
_ENC = "replace(url_encode({0}), '%20', '+')"


@query(
    f"""WITH a AS (SELECT category, location, country, trim(trim(category) || ' ' || trim(location)) AS asked FROM (SELECT {_one_of(ASKED)} || CASE WHEN s_suppkey < 8 THEN '' ELSE ' ' || s_suppkey END AS category, {_one_of(ASKED, 1)} AS location, {_one_of(ASKED, 2)} AS country FROM supplier))
SELECT category, 'https://www.google.com/search?q=' || {_ENC.format('asked')} || '&num=10&start=20&hl=' || lower(country) || '&gl=' || lower(country) AS web,
  'https://www.google.' || lower(country) || '/maps/search/' || {_ENC.format("coalesce(nullif(asked, ''), 'unternehmen')")} || '?hl=de' AS maps FROM a"""
)
def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _numbered(spark, sf_dir, ASKED, "category", "location", "country")
    own = own.withColumn("category", F.when(F.col("s_suppkey") < 8, F.col("category")).otherwise(F.concat_ws(" ", "category", "i")))
    category, location, country = (F.col(c) for c in ("category", "location", "country"))
    asked = F.trim(F.concat_ws(" ", F.trim(category), F.trim(location)))
    return own.select("category", planning.web_search_url(asked, F.lit(20), F.lower(country)).alias("web"), planning.map_search_url(category, location, country).alias("maps"))
