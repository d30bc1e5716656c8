"""The table of directory sources and the choice of sources for a category."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Categories of sources, in the order in which they are shown.
CATEGORIES = (
    "Firmenverzeichnisse, Unternehmensdatenbanken, Handelsregister, IHK / HWK, Verbaende, Hersteller, Franchise, Messen, Jobboersen, Immobilien, Gastronomie, "
    "Hotels, Aerzte, Handwerker, Marktplaetze, Lieferanten, Startups, Software, SaaS, Bewertungen, Social Media, Google, Bing, Apple, Branchen, "
    "Oeffentliche Daten, E-Commerce, Reise, Logistik, News, Ausschreibungen, Universitaeten, Foerderprogramme, GitHub, APIs, Lokale Portale, Sonstige"
).split(", ")
# Sources that can be read, as id = directory, label; ids are those of category tables, directories those of sources.directories.
IMPLEMENTED = """
Firmenverzeichnisse: gelbeseiten = gelbeseiten, Gelbe Seiten; das_oertliche = das_oertliche, Das Oertliche; telefonbuch = telefonbuch, Das Telefonbuch; 11880 = 11880, 11880; auskunft = auskunft, auskunft.de; cylex = cylex, Cylex; hotfrog = hotfrog, Hotfrog; werkenntdenbesten = werkenntdenbesten, Wer kennt den BESTEN; goyellow = goyellow, GoYellow; yelp = yelp, Yelp; europages = europages, Europages; kompass = kompass, Kompass; manta = manta, Manta; herold = herold, Herold; wko = wko, WKO Firmen A-Z
Unternehmensdatenbanken: pitchbook = pitchbook, PitchBook
Jobboersen: indeed = indeed, Indeed; stepstone = stepstone, StepStone; arbeitsagentur = arbeitsagentur, Arbeitsagentur
Aerzte: jameda = jameda, Jameda; sanego = sanego, Sanego; docfinder = docfinder, DocFinder
Gastronomie: restaurantguru = restaurantguru, Restaurant Guru
Branchen: anwaltauskunft = anwaltauskunft, Anwaltauskunft; branchen_anwaelte = anwaltauskunft, Anwaelte; steuerberater = steuerberater, Steuerberaterverzeichnis; branchen_steuerberater = steuerberater, Steuerberater; treatwell = treatwell, Treatwell; branchen_restaurants = restaurantguru, Restaurants; branchen_hotels = golocal, Hotels; branchen_immobilienmakler = gelbeseiten, Immobilienmakler; branchen_versicherungen = gelbeseiten, Versicherungen; branchen_autohaeuser = gelbeseiten, Autohaeuser; branchen_werkstaetten = gelbeseiten, Werkstaetten; branchen_bauunternehmen = gelbeseiten, Bauunternehmen; branchen_elektriker = gelbeseiten, Elektriker; branchen_instalateure = gelbeseiten, Installateure; branchen_maler = gelbeseiten, Maler; branchen_dachdecker = gelbeseiten, Dachdecker; branchen_solarfirmen = gelbeseiten, Solarfirmen; branchen_fitnessstudios = treatwell_fitness, Fitnessstudios; branchen_physiotherapeuten = jameda_physio, Physiotherapeuten; branchen_zahnaerzte = jameda_zahn, Zahnaerzte; docfinder_zahn = docfinder_zahn, DocFinder Zahnaerzte; branchen_friseure = treatwell_friseur, Friseure
Lokale Portale: golocal = golocal, GoLocal
Lieferanten: wlw = wlw, Wer liefert was (WLW); lieferanten_europages = europages, Europages; alibaba = alibaba, Alibaba; india_mart = indiamart, IndiaMART; made_in_china = made_in_china, Made-in-China; lieferanten_kompass = kompass, Kompass
Marktplaetze: marktplaetze_alibaba = alibaba, Alibaba
"""
# Sources of categories, in order of the table.
PROFILES = """
steuerberater: steuerberater branchen_steuerberater gelbeseiten herold 11880 wko wlw europages kompass
restaurant: branchen_restaurants restaurantguru golocal gelbeseiten herold yelp goyellow werkenntdenbesten hotfrog
hotel: branchen_hotels gelbeseiten herold yelp 11880 hotfrog
arzt: jameda sanego docfinder herold gelbeseiten 11880
aerzte: jameda sanego docfinder herold gelbeseiten 11880
zahnarzt: branchen_zahnaerzte docfinder_zahn jameda_zahn jameda sanego herold
physiotherapeut: branchen_physiotherapeuten jameda_physio jameda sanego gelbeseiten herold
anwalt: anwaltauskunft branchen_anwaelte gelbeseiten herold 11880 wko
friseur: branchen_friseure treatwell golocal gelbeseiten herold yelp
fitnessstudio: branchen_fitnessstudios treatwell golocal gelbeseiten herold
handwerker: gelbeseiten wlw europages lieferanten_kompass kompass herold 11880 wko werkenntdenbesten
elektriker: branchen_elektriker gelbeseiten wlw europages lieferanten_kompass herold wko
installateur: branchen_instalateure gelbeseiten wlw europages herold wko
maler: branchen_maler gelbeseiten wlw herold wko
dachdecker: branchen_dachdecker gelbeseiten wlw herold wko
bauunternehmen: branchen_bauunternehmen gelbeseiten wlw europages lieferanten_kompass herold wko
werkstatt: branchen_werkstaetten gelbeseiten herold 11880 goyellow
autohaus: branchen_autohaeuser gelbeseiten herold 11880 goyellow
immobilienmakler: branchen_immobilienmakler gelbeseiten herold golocal 11880
versicherung: branchen_versicherungen gelbeseiten herold 11880 wko
lieferant: wlw lieferanten_europages lieferanten_kompass alibaba india_mart made_in_china kompass europages
hersteller: wlw lieferanten_europages lieferanten_kompass kompass europages gelbeseiten
versand: wlw lieferanten_europages lieferanten_kompass kompass europages gelbeseiten herold 11880 das_oertliche auskunft goyellow wko indeed stepstone arbeitsagentur
logistik: wlw lieferanten_europages lieferanten_kompass kompass europages gelbeseiten herold 11880 das_oertliche auskunft goyellow wko indeed stepstone arbeitsagentur
spedition: wlw lieferanten_europages lieferanten_kompass kompass europages gelbeseiten herold 11880 das_oertliche auskunft goyellow wko
"""
# Sources of a category without a profile.
DEFAULT_SOURCES = "gelbeseiten herold 11880 das_oertliche auskunft cylex goyellow wko".split()
# Known directories that can't be read.
UNAVAILABLE = "FirmenABC, Business Branchenbuch, Brownbook, Yalwa, Yellow Pages, 192.com, Scoot, BusinessList, meinestadt.de, Firmenwissen".split(", ")

SCHEMA = "ordinal int, id string, label string, category string, scraper_key string, default_enabled boolean, implemented boolean, unavailable boolean"


def source_id(category: str, label: str) -> str:
    """The id of a source that can't be read: its category and its label in lower case, spaces and marks replaced."""
    slug = label.lower().replace(" ", "_").replace("&", "and").replace(".", "").replace("-", "_")
    return f"{category.casefold().replace(' ', '_').replace('/', '_')}_{slug}"


def implemented_rows() -> list[tuple]:
    out = []
    for line in IMPLEMENTED.strip().splitlines():
        category, _, sources = line.partition(": ")
        for own in sources.split("; "):
            name, _, rest = own.partition(" = ")
            key, _, label = rest.partition(", ")
            out.append((len(out), name, label, category, key, True, True, False))
    return out


def sources(spark: SparkSession, planned: dict[str, list[str]] | None = None) -> DataFrame:
    """The table of sources. planned: further labels by category, which a deployment knows of but can't read yet."""
    rows = implemented_rows()
    rows += [(len(rows) + i, source_id("Firmenverzeichnisse", x), x, "Firmenverzeichnisse", "", False, False, True) for i, x in enumerate(UNAVAILABLE)]
    for category, labels in (planned or {}).items():
        rows += [(len(rows) + i, source_id(category, x), x, category, "", False, False, False) for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, SCHEMA)


def active(table: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Readable sources: those selected (id), or without a selection those enabled by default."""
    own = table.filter("implemented")
    return own.filter("default_enabled") if selected is None else own.join(selected.select("id"), "id", "left_semi")


def by_category(table: DataFrame) -> DataFrame:
    """(category_rank, category, ids): the sources of each category, in their order."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")) - 1
    grouped = table.filter(rank >= 0).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda s: s["id"]).alias("ids"))
    return grouped.select(rank.alias("category_rank"), "category", "ids")


def profile_rows() -> list[tuple[int, str, str]]:
    """(rank of the profile, profile, source id)."""
    return [(i, k, s) for i, line in enumerate(PROFILES.strip().splitlines()) for k, _, ids in [line.partition(": ")] for s in ids.split()]


@F.pandas_udf(T.StringType())
def category_key(values: pd.Series) -> pd.Series:
    """Case folded, without accents, other marks as single spaces."""

    def one(v: str | None) -> str:
        bare = "".join(c for c in unicodedata.normalize("NFKD", (v or "").strip().casefold()) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare.replace("ß", "ss")).split())

    return values.map(one)


def match_profiles(categories: DataFrame) -> DataFrame:
    """(category, key, profile): the profile of the same key, else the longest that the key holds, else the first with a word of the key; null if none."""
    spark = categories.sparkSession
    profiles = F.broadcast(spark.createDataFrame(sorted({(i, k) for i, k, _ in profile_rows()}), "rank int, profile string"))
    own = categories.select("category", category_key("category").alias("key")).distinct()
    words = F.arrays_overlap(F.split("key", " "), F.split("profile", " "))
    step = F.when(F.col("key") == F.col("profile"), 0).when(F.contains("key", F.col("profile")), 1).when(words, 2)
    met = own.join(profiles, (F.col("key") != "") & (F.contains("key", F.col("profile")) | words)).withColumn("step", step)
    order = ("step", F.when(F.col("step") == 1, -F.length("profile")).otherwise(0), "rank")
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy(*order))).filter("_n = 1").select("category", "profile")
    return own.join(best, "category", "left")


def category_sources(categories: DataFrame, table: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(category, id): a category's readable sources by its profile, or the default ones; with a selection (id) what both have,
    the profile's if that's nothing, and the selection itself for a category without a profile."""
    spark = categories.sparkSession
    matched = match_profiles(categories)
    rows = spark.createDataFrame([(k, s) for _, k, s in profile_rows()] + [("", s) for s in DEFAULT_SOURCES], "profile string, id string")
    wanted = matched.withColumn("_p", F.coalesce("profile", F.lit(""))).join(F.broadcast(rows.withColumnRenamed("profile", "_p")), "_p")
    own = wanted.join(active(table).select("id"), "id", "left_semi").select("category", "profile", "id")
    if selected is None:
        return own.select("category", "id")
    both = own.join(selected.select("id"), "id", "left_semi")
    kept = own.filter("profile is not null").join(both.select("category").distinct(), "category", "left_anti")
    free = matched.filter("profile is null").select("category").crossJoin(F.broadcast(selected.select("id")))
    return both.filter("profile is not null").select("category", "id").unionByName(kept.select("category", "id")).unionByName(free)
