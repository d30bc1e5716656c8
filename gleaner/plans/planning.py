"""Query planning: categories, cities and countries to search texts, within budgets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner import tables
from gleaner.functions import text

MIN_POPULATION = 5000
#: (least limit, cities per country; None: all), from the largest limit down.
WEB_CITIES = ((3000, None), (1000, 400), (500, 150), (100, 60), (0, 40))
PAID_CITIES = ((3000, None), (1000, 800), (500, 200), (100, 40), (0, 12))
MAP_CITIES = ((3000, None), (1000, 800), (500, 200), (0, 40))
#: Pages of a query.
PAGES = ((500, 12), (100, 8), (0, 4))
MASS_LIMIT = 500


def budget(limit: int, steps: tuple[tuple[int, int | None], ...], expand: bool = False) -> int | None:
    """Cities per country for a result limit; None means all."""
    return None if expand else next(n for least, n in steps if limit >= least or not least)


def osm_budget(limit: int, expand: bool = False) -> int | None:
    return None if expand or limit >= MASS_LIMIT else max(8, min(40, -(-limit // 3)))


def page_depth(plans: int, mass: bool, expand: bool = False) -> int:
    """The last result offset to page to, less for more plans."""
    return 90 if expand or not mass or plans <= 30 else 40 if plans <= 150 else 10


def pages_per_query(limit: int) -> int:
    return budget(limit, PAGES)


def budget_of(limit: Column, steps: tuple[tuple[int, int | None], ...]) -> Column:
    """budget of a column of limits; null means all."""
    return reduce(lambda rest, step: F.when(limit >= step[0], F.lit(step[1]).cast("int")).otherwise(rest), reversed(steps[:-1]), F.lit(steps[-1][1]).cast("int"))


def osm_budget_of(limit: Column) -> Column:
    return F.when(limit < MASS_LIMIT, F.greatest(F.lit(8), F.least(F.lit(40), F.ceil(limit / 3)))).cast("int")


def per_domain_limit_of(limit: Column, domains: int = len(tables.SOURCE_DOMAINS)) -> Column:
    return F.greatest(F.lit(1), F.ceil(limit / domains)).cast("int")


def places_per_city(limit: int, plans: int, default: int = 25, most: int = 60) -> int:
    return default if plans <= 0 else max(10, min(most, limit // plans + 5))


def per_location_limit(limit: int, locations: int, floor: int = 100) -> int:
    """Rows per map location: a fair share, at least floor, at most all."""
    return min(limit, max(floor, -(-limit // max(1, locations))))


def per_source_limit(limit: int, locations: int, sources: int, cap: int | None = 120, floor: int = 10) -> int:
    """Rows per directory and location, at most cap."""
    share = max(floor, -(-max(1, -(-limit // max(1, locations))) // max(1, sources)))
    return share if cap is None else min(share, cap)


def per_domain_limit(limit: int, domains: int = len(tables.SOURCE_DOMAINS)) -> int:
    return max(1, -(-limit // domains))


def page_depth_of(plans: Column, mass: Column) -> Column:
    return F.when(~mass | (plans <= 30), 90).when(plans <= 150, 40).otherwise(10)


def places_per_city_of(limit: Column, plans: Column, default: int = 25, most: int = 60) -> Column:
    return F.when(plans <= 0, default).otherwise(F.greatest(F.lit(10), F.least(F.lit(most), F.floor(limit / plans) + 5))).cast("int")


def per_location_limit_of(limit: Column, locations: Column, floor: int = 100) -> Column:
    return F.least(limit, F.greatest(F.lit(floor), F.ceil(limit / F.greatest(F.lit(1), locations)))).cast("int")


def per_source_limit_of(limit: Column, locations: Column, sources: Column, cap: int | None = 120, floor: int = 10) -> Column:
    each = F.greatest(F.lit(1), F.ceil(limit / F.greatest(F.lit(1), locations)))
    share = F.greatest(F.lit(floor), F.ceil(each / F.greatest(F.lit(1), sources)))
    return (share if cap is None else F.least(share, F.lit(cap))).cast("int")


@dataclass(frozen=True)
class Caps:
    """Caps of a directory run: rows per source, detail pages, listing pages."""

    source: int | None
    details: int | None
    pages: int


DIRECTORY_CAPS = {"normal": Caps(120, 30, 3), "fast": Caps(None, 10, 1), "mass": Caps(200, 100, 5)}


#: Locations that meet a category at once, about.
LOCATIONS_SENT = 50_000


def keyword_matches(keyword: Column, category: Column) -> Column:
    """Whether a keyword applies to a category in lower case: as a part, or as a whole word if it has two letters at most."""
    word = F.concat(F.lit("(?<![a-z0-9äöüß])"), keyword, F.lit("(?![a-z0-9äöüß])"))
    return (keyword != "") & F.when(F.length(keyword) <= 2, F.rlike(category, word)).otherwise(F.contains(category, keyword))


def cross_plan(categories: DataFrame, locations: DataFrame) -> DataFrame:
    """Each category with each location; without locations, with ''.

    All pairs are the plan. Locations are sent to the categories' tasks in blocks of LOCATIONS_SENT, so that no task holds them all.
    """
    own = locations.select("location")
    none = own.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("").alias("location"))
    own = own.unionByName(none)
    blocks = -(-own.count() // LOCATIONS_SENT)
    keyed = own.withColumn("_b", F.pmod(F.xxhash64("location"), F.lit(blocks))).groupBy("_b").agg(F.collect_list("location").alias("_all"))
    each = categories.select("category", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_b"))
    return each.join(keyed, "_b").select("category", F.explode("_all").alias("location"))


def category_variants(categories: DataFrame) -> DataFrame:
    """(category, place, term): the terms of the longest keyword that applies (the earlier of equal ones), else the category itself.

    The keyword table is a fixed, small one: it is broadcast.
    """
    spark = categories.sparkSession
    own = categories.select(F.trim("category").alias("category")).filter("category <> ''").distinct()
    words = F.broadcast(tables.variants(spark).filter("place = 0").select("rank", "keyword"))
    met = own.join(words, keyword_matches(F.col("keyword"), F.lower("category")))
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy(F.length("keyword").desc(), "rank"))).filter("_n = 1")
    found = best.join(F.broadcast(tables.variants(spark).drop("keyword")), "rank").select("category", "place", "term")
    return found.unionByName(own.join(best, "category", "left_anti").select("category", F.lit(0).alias("place"), F.col("category").alias("term")))


def escape_overpass(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r'(["\\])', r"\\$1"), r"([.+*?^$()\[\]{}|])", r"\\$1")


def osm_selectors(categories: DataFrame) -> DataFrame:
    """(category, place, selector): those of all keywords that apply, once each in order, else a search by name."""
    spark = categories.sparkSession
    own = categories.select("category").distinct()
    tags = F.broadcast(tables.osm_tags(spark))
    met = own.join(tags, keyword_matches(F.col("keyword"), F.lower("category")))
    named = F.when(F.col("tag_value") == "", F.concat(F.lit('["'), "tag_key", F.lit('"]'))).otherwise(F.concat(F.lit('["'), "tag_key", F.lit('"="'), "tag_value", F.lit('"]')))
    first = met.withColumn("selector", named).groupBy("category", "selector").agg(F.min(F.struct("rank", "place")).alias("at"))
    ranked = first.select("category", (F.row_number().over(Window.partitionBy("category").orderBy("at")) - 1).alias("place"), "selector")
    by_name = F.concat(F.lit('["name"~"'), escape_overpass(F.trim("category")), F.lit('",i]'))
    return ranked.unionByName(own.join(first, "category", "left_anti").select("category", F.lit(0).alias("place"), by_name.alias("selector")))


def overpass_queries(categories: DataFrame, location: str, limit: int, country: str | None = None) -> DataFrame:
    """(category, query): the map database's query text of each category."""
    if country:
        area = f'area["ISO3166-1"="{country}"][admin_level=2]->.searchArea;\n'
    elif location.strip():
        area = None
    else:
        area = ""
    scope = "(area.searchArea);" if area != "" else ";"
    by_name = F.concat(F.lit('area["name"~"^'), escape_overpass(F.lit(location.strip())), F.lit('$",i]["boundary"="administrative"]->.searchArea;\n'))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "selector"))), lambda s: F.concat(F.lit("nwr"), s["selector"], F.lit(scope))), "\n")
    text_ = F.concat(F.lit("[out:json][timeout:35];\n"), by_name if area is None else F.lit(area), F.lit("(\n"), lines, F.lit(f"\n);\nout tags center {max(limit * 10, 200)};"))
    return osm_selectors(categories).groupBy("category").agg(text_.alias("query"))


def best_cities(elements: DataFrame) -> DataFrame:
    """(country, name, population, rank) from named places (country, name, population as text): the largest of each name, from MIN_POPULATION up."""
    own = elements.select("country", F.trim("name").alias("name"), text.population(F.col("population")).alias("population"))
    best = own.filter((F.col("name") != "") & (F.col("population") >= MIN_POPULATION)).groupBy("country", "name").agg(F.max("population").alias("population"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("population"), "name")))


def top_cities(cities: DataFrame, per_country: int | None) -> DataFrame:
    """A country's first cities; all of them for None."""
    return cities if per_country is None else cities.filter(F.col("rank") <= max(per_country, 0))


def _countries(spark: SparkSession, countries: tuple[str, ...]) -> DataFrame:
    rows = [(i, c, tables.COUNTRIES[c]) for i, c in enumerate(countries) if c in tables.COUNTRIES]
    return spark.createDataFrame(rows, "country_rank int, country string, label string")


def search_plans(category: str, location: str, cities: DataFrame, countries: tuple[str, ...] = ("DE",), limit: int = 50, expand: bool = False) -> DataFrame:
    """(part, country_rank, place, query, country) for web searches: countries first, then their cities; with expand also broad searches and all cities."""
    spark = cities.sparkSession
    known = F.broadcast(_countries(spark, countries))
    if location.strip():
        code = countries[0] if countries else "DE"
        base = spark.createDataFrame([(0, 0, 0, location, code)], "part int, country_rank int, place int, label string, country string")
        wide, towns = base, None
    else:
        base = known.select(F.lit(0).alias("part"), "country_rank", F.lit(0).alias("place"), "label", "country")
        wide = base
        towns = top_cities(cities, budget(limit, WEB_CITIES, expand)).join(known.drop("label"), "country").select(F.lit(1).alias("part"), "country_rank", F.col("rank").alias("place"), F.col("name").alias("label"), "country")
    out = base.withColumn("query", text.build_query(F.lit(category), F.col("label")))
    if expand:
        out = out.unionByName(wide.withColumn("place", F.lit(1)).withColumn("query", text.build_query(F.lit(category), F.col("label"), broad=True)))
    if towns is not None:
        out = out.unionByName(towns.withColumn("query", text.build_query(F.lit(category), F.col("label"))))
    return out.select("part", "country_rank", "place", "query", "country")


def synonym_plans(category: str, location: str, cities: DataFrame, countries: tuple[str, ...] = ("DE",), limit: int = 50, expand: bool = False) -> DataFrame:
    """(part, country_rank, place, variant, query, country) of a paid search: countries by terms, cities by terms (the main one alone if there are over 60 cities), then the other terms over fewer cities."""
    spark = cities.sparkSession
    broad = expand or limit >= MASS_LIMIT
    terms = category_variants(spark.createDataFrame([(category,)], "category string")).select(F.col("place").alias("variant"), "term")
    known = F.broadcast(_countries(spark, countries))
    query = text.build_query(F.col("term"), F.col("label"), broad)
    columns = ("part", "country_rank", "place", "variant", "query", "country")
    if location.strip():
        code = countries[0] if countries else "DE"
        return terms.select(F.lit(0).alias("part"), F.lit(0).alias("country_rank"), F.lit(0).alias("place"), "variant", F.lit(location).alias("label"), "term", F.lit(code).alias("country")).withColumn("query", query).select(*columns)
    out = known.crossJoin(terms).select(F.lit(0).alias("part"), "country_rank", F.lit(0).alias("place"), "variant", "label", "term", "country")
    per = budget(limit, PAID_CITIES, expand)

    def by_city(towns: DataFrame, own: DataFrame, part: int) -> DataFrame:
        named = towns.join(known.drop("label"), "country").select("country_rank", F.col("rank").alias("place"), F.col("name").alias("label"), "country")
        return named.crossJoin(F.broadcast(own)).select(F.lit(part).alias("part"), "country_rank", "place", "variant", "label", "term", "country")

    towns = top_cities(cities, per).join(known.select("country"), "country", "left_semi")
    main = terms if expand or towns.limit(61).count() <= 60 else terms.filter("variant = 0")
    out = out.unionByName(by_city(towns, main, 1))
    if expand or limit >= 1000:
        fewer = towns.join(known.select("country", "country_rank"), "country").orderBy("country_rank", "rank").limit(120).drop("country_rank") if per is None else top_cities(cities, min(per, 80))
        out = out.unionByName(by_city(fewer, terms.filter("variant > 0"), 2))
    return out.withColumn("query", query).select(*columns)


def site_searches(categories: DataFrame, limit: int) -> DataFrame:
    """(category, domain_rank, query, rows): each category narrowed to each source domain, and its rows at most."""
    domains = categories.sparkSession.createDataFrame(list(enumerate(tables.SOURCE_DOMAINS)), "domain_rank int, domain string")
    return categories.select("category").crossJoin(F.broadcast(domains)).select("category", "domain_rank", F.concat("category", F.lit(" site:"), "domain").alias("query"), F.lit(per_domain_limit(limit)).alias("rows"))


def city_names(cities: DataFrame, countries: tuple[str, ...]) -> DataFrame:
    """(country_rank, rank, name): the countries' cities in order, a name of several countries once, at its first."""
    known = F.broadcast(_countries(cities.sparkSession, countries))
    own = cities.join(known, "country").withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("country_rank", "rank")))
    return own.filter("_n = 1").select("country_rank", "rank", "name")


def locations(location: str, cities: DataFrame, countries: tuple[str, ...] = ("DE",), per_country: int | None = None, fallback: str = "Berlin") -> DataFrame:
    """(place, label): the location itself, else the countries' cities in order, else the fallback."""
    spark = cities.sparkSession
    if location.strip():
        return spark.createDataFrame([(0, location.strip())], "place long, label string")
    known = F.broadcast(_countries(spark, countries))
    own = top_cities(cities, per_country).join(known.select("country", "country_rank"), "country")
    named = own.select((F.col("country_rank") * 1_000_000 + F.col("rank")).cast("long").alias("place"), F.col("name").alias("label"))
    return named if not named.isEmpty() else spark.createDataFrame([(0, fallback)], "place long, label string")


def _query_string(**parameters: Column) -> Column:
    """Parameters in order, encoded as a form's: spaces as +."""
    return F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in parameters.items()))


def web_search_url(query: Column, start: Column, locale: Column) -> Column:
    """Address of a result page of a web search."""
    return F.concat(F.lit("https://www.google.com/search?"), _query_string(q=query, num=F.lit(10), start=start, hl=locale, gl=locale))


def map_search_url(category: Column, location: Column, country: Column) -> Column:
    """Address of a map search in a country's language."""
    asked = F.array_join(F.filter(F.array(F.trim(category), F.trim(location)), lambda p: p != ""), " ")
    host = F.when(country == "AT", "www.google.at").otherwise("www.google.de")
    return F.concat(F.lit("https://"), host, F.lit("/maps/search/"), F.url_encode(F.when(asked == "", "unternehmen").otherwise(asked)), F.lit("?hl=de"))
