"""Queries of operators whose inputs the test tables don't have: over payloads, pages and entries made for each supplier, with SQL or the rows that each supplier must give as twins."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import errors, html, text
from gleaner.operators import dedupe, messages
from gleaner.sources import directories, providers, registry, search
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


#: Stands for the supplier's number in texts.
_I = "{i}"


def _over(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str, number: str = "") -> DataFrame:
    """These rows for each supplier, with its number in texts; number: a column of places, which go on from supplier to supplier."""
    fields = [f.split(" ", 1) for f in re.split(r", (?![^<]*>)", schema)]
    each = F.array(*(F.struct(*(_literal(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True))) for row in rows))
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("_n"), F.explode(each).alias("_r")).select("_n", "_r.*")
    i = F.col("_n").cast("string")
    for name, kind in fields:
        if kind == "string":
            own = own.withColumn(name, F.replace(F.col(name), F.lit(_I), i))
        elif kind == "array<string>":
            own = own.withColumn(name, F.transform(name, lambda x: F.replace(x, F.lit(_I), i)))
        elif name == number:
            own = own.withColumn(name, (F.col("_n") * len(rows) + F.col(name)).cast(kind))
    return own.drop("_n")


def _literal(v) -> Column:
    return F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)


def _text(c: str) -> str:
    return f"replace({c}, '{_I}', CAST(s_suppkey AS VARCHAR))"


def _each(rows: list[tuple], names: str, places: int = 0, of: str = "") -> str:
    """SQL: these rows for each supplier. of: a column of places, ``places`` a supplier; ordinals count items in such places, a million each."""
    columns = []
    for k, name in enumerate(names.split(", ")):
        if any(isinstance(r[k], str) for r in rows):
            columns.append(f"{_text(name)} AS {name}")
        elif name == of == "ordinal":
            columns.append(f"(s_suppkey * {places} + ordinal // 1000000) * 1000000 + ordinal % 1000000 AS ordinal")
        elif name == of:
            columns.append(f"s_suppkey * {places} + {name} AS {name}")
        else:
            columns.append(name)
    return f"SELECT {', '.join(columns)} FROM supplier, {values_sql(rows, names)}"


def _payloads(payloads: list[str]) -> str:
    """SQL: the responses of ``_responses``."""
    return f"({_each(list(enumerate(payloads)), 'response, payload', len(payloads), 'response')})"


def _responses(spark: SparkSession, sf_dir: str, payloads: list[str]) -> DataFrame:
    return _over(spark, sf_dir, list(enumerate(payloads)), "response long, payload string", "response")


OSM = [
    json.dumps({"elements": [
        {"tags": {"name": "Hotel A", "website": "www.a{i}.example", "addr:street": "Weg", "addr:housenumber": "1", "addr:city": "Berlin"}},
        {"tags": {"name": "Hotel A again", "url": "https://WWW.A{i}.example/"}},
        {"tags": {"name": "No site"}},
        {"tags": {"contact:website": "ftp://b{i}.example"}},
        {"tags": {"contact:url": "http://c{i}.example/x"}},
        {},
    ]}),
    json.dumps({"elements": []}), "not json",
]
_JS = "(SELECT response, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM {0})"


@query(
    f"""WITH e AS (SELECT response, unnest(json_extract(j, '$.elements[*]')) AS el, generate_subscripts(json_extract(j, '$.elements[*]'), 1) - 1 AS place FROM {_JS.format(_payloads(OSM))}),
t AS (SELECT response * 1000000 + place AS ordinal, el->'tags' AS g, coalesce(nullif(el->'tags'->>'website', ''), nullif(el->'tags'->>'contact:website', ''), nullif(el->'tags'->>'url', ''), nullif(el->'tags'->>'contact:url', ''), '') AS raw FROM e),
u AS (SELECT ordinal, g, CASE WHEN raw = '' THEN '' WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN raw ELSE 'https://' || raw END AS url FROM t),
v AS (SELECT *, array_to_string(list_filter([g->>'addr:street', g->>'addr:housenumber', g->>'addr:postcode', g->>'addr:city'], lambda p: p <> ''), ' ') AS addr FROM u WHERE regexp_matches(url, '^https?://[^/]')),
n AS (SELECT *, row_number() OVER (PARTITION BY rtrim(lower(url), '/') ORDER BY ordinal) AS k FROM v)
SELECT ordinal, coalesce(g->>'name', url) AS title, url, CASE WHEN addr = '' THEN 'OpenStreetMap result' ELSE 'OpenStreetMap: ' || addr END AS snippet FROM n WHERE k = 1"""
)
def osm_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.osm(_responses(spark, sf_dir, OSM)).select("ordinal", "title", "url", "snippet")


NOMINATIM = [
    json.dumps([
        {"name": "Hotel B", "display_name": "Hotel B, Köln", "extratags": {"website": "https://b{i}.example"}, "address": {"city": "Köln"}},
        {"name": "", "display_name": "Hotel C, Bonn", "extratags": {"contact:website": "c{i}.example"}, "address": {"town": "Bonn"}},
        {"name": "Hotel D", "extratags": {"website": "https://d{i}.example"}, "address": {"state": "Groß-Köln"}},
        {"name": "Hotel E", "extratags": None, "address": {"city": "Köln"}},
        {"display_name": "Hotel B twin", "extratags": {"url": "https://B{i}.example//"}, "address": {"city": "köln"}},
    ])
]


@query(_each([(0, "Hotel B", "https://b{i}.example", "Nominatim: Hotel B, Köln"), (2, "Hotel D", "https://d{i}.example", "Nominatim: OpenStreetMap/Nominatim result")], "ordinal, title, url, snippet", len(NOMINATIM), "ordinal"))
def nominatim_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.nominatim(_responses(spark, sf_dir, NOMINATIM), " KÖLN ").select("ordinal", "title", "url", "snippet")


SERP = [
    json.dumps({"organic_results": [{"title": "A", "link": "https://a{i}.example/", "snippet": "s"}, {"title": "A2", "link": "HTTPS://A{i}.example", "snippet": "t"}, {"title": "rel", "link": "/x"}, {"title": "none"}]}),
    json.dumps({"organic_results": [{"title": "B", "link": "http://b{i}.example"}, {"title": "A3", "link": "https://a{i}.example"}]}),
]


@query(
    f"""WITH e AS (SELECT response, unnest(json_extract(payload::JSON, '$.organic_results[*]')) AS el, generate_subscripts(json_extract(payload::JSON, '$.organic_results[*]'), 1) - 1 AS place FROM {_payloads(SERP)}),
n AS (SELECT response * 1000000 + place AS ordinal, el->>'title' AS title, el->>'link' AS url, coalesce(el->>'snippet', '') AS snippet, row_number() OVER (PARTITION BY rtrim(lower(el->>'link'), '/') ORDER BY response, place) AS k FROM e WHERE regexp_matches(el->>'link', '^(?i)https?://[^/]'))
SELECT ordinal, title, url, snippet FROM n WHERE k = 1"""
)
def serp_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.serpapi(_responses(spark, sf_dir, SERP)).select("ordinal", "title", "url", "snippet")


ZEN = [json.dumps({"organic": [{"title": "A", "url": "https://a{i}.example", "snippet": "s", "description": "d"}, {"title": "B", "link": "https://b{i}.example", "url": "x", "snippet": "t"}]}), json.dumps({"organic_results": [{"title": "C", "link": "https://a{i}.example/"}, {"title": "D", "link": "https://d{i}.example"}]})]


@query(_each([(0, "A", "https://a{i}.example", "d"), (1, "B", "https://b{i}.example", "t"), (1000001, "D", "https://d{i}.example", "")], "ordinal, title, url, snippet", len(ZEN), "ordinal"))
def zenrows_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.zenrows(_responses(spark, sf_dir, ZEN)).select("ordinal", "title", "url", "snippet")


@query(_each([("brave", 0, "A", "https://a{i}.example", "d"), ("bing", 0, "B", "https://b{i}.example", "s"), ("google", 0, "C", "https://c{i}.example", "s"), ("google", 2, "C", "https://c{i}.example", "s")], "source, ordinal, title, url, snippet", 1, "ordinal"))
def api_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    brave = providers.brave(_responses(spark, sf_dir, [json.dumps({"web": {"results": [{"title": "A", "url": "https://a{i}.example", "description": "d"}, {"title": "no url"}]}})]))
    bing = providers.bing(_responses(spark, sf_dir, [json.dumps({"webPages": {"value": [{"name": "B", "url": "https://b{i}.example", "snippet": "s"}, {"url": ""}]}})]))
    c = {"title": "C", "link": "https://c{i}.example", "snippet": "s"}
    google = providers.google(_responses(spark, sf_dir, [json.dumps({"items": [c, {"link": "ftp://x"}, c]})]))
    out = None
    for name, df in (("brave", brave), ("bing", bing), ("google", google)):
        df = df.select(F.lit(name).alias("source"), "ordinal", "title", "url", "snippet")
        out = df if out is None else out.unionByName(df)
    return out


DDG = [
    '<a rel="nofollow" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa{i}.example%2Fx%3Fy%3D1&amp;rut=9">A</a><a class="result__url" href="https://a{i}.example/x?y=1">A</a>'
    '<a class="result__a" href="https://b{i}.example">B</a><a class="result__a" href="https://duckduckgo.com/about">own</a><a href="https://c{i}.example">no result</a>'
    '<form><input name="q" value="x"><input name="s" value="30"></form>',
    '<a class="result__a" href="/relative">r</a>',
]


@query(_each([(0, "https://a{i}.example/x?y=1"), (2, "https://b{i}.example")], "ordinal, url", len(DDG), "ordinal"))
def ddg_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.duckduckgo(_responses(spark, sf_dir, DDG)).select("ordinal", "url")


@query(_each([(0, 30), (1, 40), (2, 70)], "response, next_offset", 3, "response"))
def ddg_next_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _responses(spark, sf_dir, [*DDG, "nothing"]).withColumns({"offset": F.lit(30), "links": F.when(F.col("response") % 3 == 2, 80).otherwise(4)})
    return providers.duckduckgo_next(own)


MAPS = ["", "<p>Bevor Sie zu Google weitergehen", "our systems have detected unusual traffic", '<a class="hfpxzc" href="/x">', "see https://www.google.de/maps/search/hotel", "<html>else", "Suche in Maps", "/sorry/index /maps/place/x"]


@query(_each(list(enumerate(("empty", "consent_wall", "captcha", "listings_present", "search_loaded_no_listings", "unknown", "search_loaded_no_listings", "captcha"))), "response, page_class", len(MAPS), "response"))
def map_page_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir, MAPS).select("response", providers.page_class(F.col("payload")).alias("page_class"))


LISTING = [
    '<a class="hfpxzc" aria-label="A" href="https://www.google.com/maps/place/Hotel+A/data=1?x=1"></a><a href="https://www.google.com/maps/place/hotel+a/data=1?x=2"></a>'
    '<a href="/maps/place/Hotel%20B/@1"></a> {"u":"https:\\/\\/www.google.de\\/maps\\/place\\/C"} "/maps/place/D"',
    "none",
]


@query(_each([(0, 0, "https://www.google.com/maps/place/Hotel+A/data=1?x=1"), (0, 1, "https://www.google.de/maps/place/C"), (0, 2, "https://www.google.com/maps/place/Hotel%20B/@1"), (0, 3, "https://www.google.com/maps/place/D")], "response, place, place_url", len(LISTING), "response"))
def map_place_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.place_urls(_responses(spark, sf_dir, LISTING))


@query(_each([(0, "Hotel A", "https://a{i}.example"), (1, "Hotel B & Co", "https://b{i}.example"), (4, "e{i}.example", "http://e{i}.example")], "ordinal, title, url"))
def map_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = "https://www.google.com/maps/place/"
    rows = [(base + "x", "Hotel A", ["https://google.com/x", "//a{i}.example/"], 0), (base + "Hotel+B+%26+Co/@1", "", ["b{i}.example"], 1), (base + "c", "C", [], 2), (base + "d", "D", ["https://B{i}.example/"], 3), ("x", "", ["http://e{i}.example"], 4)]
    return providers.map_details(_over(spark, sf_dir, rows, "place_url string, name string, websites array<string>, ordinal long")).select("ordinal", "title", "url")


def _cf(email: str, key: int) -> str:
    return bytes([key, *(ord(c) ^ key for c in email)]).hex()


CF = [(_cf("info@hotel.example", 0x2A),), ("zz",), ("2a",), (_cf("nobody", 3),), ("2a0",), (_cf("a@b.de", 255).upper(),)]


@query(
    f"""SELECT s_suppkey, raw, CASE WHEN regexp_matches(raw, '^([0-9a-fA-F]{{2}}){{2,}}$') AND contains(plain, '@') THEN plain ELSE '' END AS email FROM (
  SELECT s_suppkey, raw, list_aggregate(list_transform(range(3, length(raw), 2), lambda i: chr(xor(coalesce(try_cast('0x' || substr(raw, i, 2) AS INT), 64), coalesce(try_cast('0x' || substr(raw, 1, 2) AS INT), 0)))), 'string_agg', '') AS plain FROM supplier, {values_sql(CF, 'raw')})"""
)
def cfemail_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, [(_I, r) for (r,) in CF], "supplier string, raw string").select(F.col("supplier").cast("long").alias("s_suppkey"), "raw", html.cf_email_of("raw").alias("email"))


PAGES = [
    (0, "Kontakt: info@example.de oder sales [at] example [dot] com"),
    (1, "Mail: info<span>@</span>hotel-split.de bitte"),
    (2, "<td>info@a.de</td><td>xyz</td>"),
    (3, f'<a class="__cf_email__" data-cfemail="{_cf("reservierung@hotel-x.de", 0x17)}">[email&#160;protected]</a>'),
    (4, "logo@2x.png a&#64;b.de x@y.<!-- -->org"),
    (5, ""),
]


@query(_each([(0, "info@example.de"), (0, "sales@example.com"), (1, "info@hotel-split.de"), (2, "info@a.de"), (3, "reservierung@hotel-x.de"), (4, "a@b.de"), (4, "x@y.org")], "page_id, email", len(PAGES), "page_id"))
def tag_split_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, PAGES, "page_id long, html string", "page_id").select("page_id", F.explode(html.page_emails_of("html")).alias("email"))


LINKED = [
    (0, "https://www.h{i}.example.de/en/", '<title> My  Hotel </title><a href="/kontakt#form">x</a><a href="https://other.example/kontakt">y</a><a href="mailto:a@b.de">m</a><a href="sub/team">t</a><a href="/x" aria-label="Über uns">u</a><a href="https://shop.h{i}.example.de/impressum">s</a><a href="#kontakt">f</a><a href="/rooms">r</a>'),
    (1, "https://b.example", "<title>One</title><title>Two</title>"),
]


@query(_each([(0, "My Hotel", x) for x in ("https://shop.h{i}.example.de/impressum", "https://www.h{i}.example.de/en/sub/team", "https://www.h{i}.example.de/kontakt", "https://www.h{i}.example.de/x")] + [(1, "One Two", None)], "page_id, title, link", len(LINKED), "page_id"))
def contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _over(spark, sf_dir, LINKED, "page_id long, url string, html string", "page_id").select("page_id", html.parse_page_of("html", "url").alias("p"))
    return own.select("page_id", "p.title", F.explode_outer("p.links").alias("link"))


ROLES = [(e,) for e in ("kontakt@x{i}.de", "max.mustermann@x{i}.de", "info-berlin@x{i}.de", "in.fo@x{i}.de", "Team@x{i}.de", "xinfo@x{i}.de", "123@x{i}.de", "büro@x{i}.de", "no-at")]


@query(
    f"SELECT email, CASE WHEN regexp_matches(regexp_replace(lower(split_part(email, '@', 1)), '[^\\p{{L}}]', '', 'g'), '^(admin|booking|contact|customerservice|hello|hilfe|info|kontakt|office|reservierung|sales|service|support|team|vertrieb)') THEN 'business_public' ELSE 'personal_review_required' END AS consent_status FROM ({_each(ROLES, 'email')})"
)
def email_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, ROLES, "email string").select("email", text.classify_email(F.col("email")).alias("consent_status"))


ENTRIES = [
    ("A", "https://a{i}.example/", "{i}src1", "", "info@a{i}.example", " 1 ", 0),
    ("A2", "HTTPS://A{i}.example", "{i}src2", "s", "", "", 1),
    ("mail only", "", "{i}src3", "", "E-Mail: info@a{i}.example", "", 2),
    ("other mail", "", "{i}src4", "t", "mailto:x@b{i}.example", "", 3),
    ("late site", "b{i}.example", "{i}src5", "", "x@b{i}.example", "", 4),
    ("directory", "https://www.yelp.de/x", "{i}src6", "", "y@c{i}.example", "", 5),
    ("nothing", "https://facebook.com/x", "{i}src7", "", "bad", "", 6),
    ("", "https://d{i}.example", "{i}src8", "", "", "", 7),
]


@query(
    _each([("A", "https://a{i}.example/", "Branchenverzeichnis: {i}src1", "info@a{i}.example", "1", "{i}src1", 0), ("other mail", "", "t", "x@b{i}.example", "", "{i}src4", 3), ("late site", "https://b{i}.example", "Branchenverzeichnis: {i}src5", "x@b{i}.example", "", "{i}src5", 4),
           ("directory", "", "Branchenverzeichnis: {i}src6", "y@c{i}.example", "", "{i}src6", 5), ("https://d{i}.example", "https://d{i}.example", "Branchenverzeichnis: {i}src8", "", "", "{i}src8", 7)], "title, url, snippet, directory_email, directory_phone, directory_source_url, ordinal")
)
def entries_to_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.entries_to_results(_over(spark, sf_dir, ENTRIES, "name string, website string, source_url string, snippet string, email string, phone string, ordinal int"))


def _sources(spark: SparkSession) -> DataFrame:
    return registry.sources(spark, {"Hotels": ["Booking", "Hotels.com"]})


#: Sources that suppliers say they are listed in, and which scraper reads each; the last two can't be read.
LISTINGS = [
    *((k, k) for k in "gelbeseiten das_oertliche telefonbuch 11880 auskunft cylex hotfrog werkenntdenbesten goyellow kompass europages yelp manta pitchbook indeed stepstone arbeitsagentur jameda sanego "
      "restaurantguru docfinder anwaltauskunft steuerberater treatwell herold wko golocal wlw alibaba made_in_china docfinder_zahn".split()),
    ("india_mart", "indiamart"), ("branchen_hotels", "golocal"), ("branchen_restaurants", "restaurantguru"), ("branchen_zahnaerzte", "jameda_zahn"), ("branchen_physiotherapeuten", "jameda_physio"),
    ("branchen_friseure", "treatwell_friseur"), ("branchen_fitnessstudios", "treatwell_fitness"), ("branchen_anwaelte", "anwaltauskunft"), ("branchen_steuerberater", "steuerberater"),
    ("lieferanten_kompass", "kompass"), ("lieferanten_europages", "europages"), ("marktplaetze_alibaba", "alibaba"),
    *((f"branchen_{k}", "gelbeseiten") for k in "immobilienmakler versicherungen autohaeuser werkstaetten bauunternehmen elektriker instalateure maler dachdecker solarfirmen".split()),
    ("hotels_booking", None), ("no such", None),
]
_LISTED = f"(SELECT s_suppkey, id, scraper_key FROM supplier JOIN {values_sql([(i, *r) for i, r in enumerate(LISTINGS)], 'place, id, scraper_key')} ON s_suppkey % {len(LISTINGS)} = place)"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(*(F.lit(i) for i, _ in LISTINGS))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.get(ids, (F.col("s_suppkey") % len(LISTINGS)).cast("int")).alias("id"))


@query(f"SELECT scraper_key, count(*) AS suppliers, min(s_suppkey) AS first FROM {_LISTED} WHERE scraper_key IS NOT NULL GROUP BY 1")
def source_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = registry.active(_sources(spark)).join(_listed(spark, sf_dir), "id")
    return own.groupBy("scraper_key").agg(F.count("*").alias("suppliers"), F.min("s_suppkey").alias("first"))


@query(f"SELECT s_suppkey, id, CASE WHEN id LIKE 'branchen%' THEN 'Branchen' ELSE 'Firmenverzeichnisse' END AS category FROM {_LISTED} WHERE id IN ('yelp', 'wko', 'branchen_hotels')")
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sources that suppliers name, those of a selection, in which some can't be read."""
    selected = spark.createDataFrame([("yelp",), ("wko",), ("branchen_hotels",), ("no such",), ("hotels_booking",)], "id string")
    return registry.active(_sources(spark), selected).join(_listed(spark, sf_dir), "id").select("s_suppkey", "id", "category")


#: What a supplier does, its key, and the profile it must get.
NAMED = [
    ("Hotel {i}", "hotel {i}", "hotel"), ("hotel garni {i}", "hotel garni {i}", "hotel"), ("Zahnärzte Zahnarzt {i}", "zahnarzte zahnarzt {i}", "zahnarzt"), ("Steuer-Berater {i}", "steuer berater {i}", None),
    ("KFZ Werkstatt & Autohaus {i}", "kfz werkstatt autohaus {i}", "werkstatt"), ("{i} Ärzte", "{i} arzte", "arzt"), ("Goldschmied {i}", "goldschmied {i}", None), (" {i}. ", "{i}", None),
    ("Spedition/Logistik {i}", "spedition logistik {i}", "spedition"), ("maler {i}", "maler {i}", "maler"), ("Straßenbau {i}", "strassenbau {i}", None),
]


@query(_each(NAMED, "category, key, profile"))
def profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.match_profiles(_over(spark, sf_dir, [(c,) for c, _, _ in NAMED], "category string"))


@query(
    _each([("hotel garni {i}", x) for x in ("yelp", "gelbeseiten")] + [("Goldschmied {i}", x) for x in ("yelp", "gelbeseiten", "indeed")] + [("Zahnarzt {i}", x) for x in ("branchen_zahnaerzte", "docfinder_zahn", "jameda", "sanego", "herold")], "category, id")
)
def category_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a selection: what it and the profile share; the profile's own sources where they share none; the selection itself without a profile."""
    selected = spark.createDataFrame([("yelp",), ("gelbeseiten",), ("indeed",)], "id string")
    return registry.category_sources(_over(spark, sf_dir, [("hotel garni {i}",), ("Goldschmied {i}",), ("Zahnarzt {i}",)], "category string"), _sources(spark), selected)


_OWN = "https://www.wirt{i}-am-eck.example"
LISTED = [
    ("gelbeseiten", "{i}l1", '<article class="mod mod-Treffer" id="a"><a href="https://www.gelbeseiten.de/gsbiz/{i}"><h2 class="mod-Treffer__name">Wirt</h2></a></article>', 1),
    ("yelp", "{i}l2", '<a href="/biz/wirt-berlin-{i}?osq=x">x</a><a href="/biz/gast-{i}">y</a>', 1),
    ("wko", "{i}l3", f"<article class='search-result-article'><a class=\"title-link\" href=\"/wirt{{i}}\"><h3>Wirt</h3></a><a class='kontaktinfo-web-click' href='{_OWN}'></a></article>", 1),
]
DETAILED = [
    ("https://www.gelbeseiten.de/gsbiz/{i}", f'<title>Wirt am Eck | Gelbe</title><div class="contains-icon-big-homepage"><a href="{_OWN}"></div> info@wirt{{i}}-am-eck.example'),
    ("https://www.yelp.de/biz/wirt-berlin-{i}", '<a href="/biz_redir?url=https%3A%2F%2Fwww.wirt{i}-am-eck.example&amp;c=1">'),
    ("https://www.yelp.de/biz/gast-{i}", "nothing"),
]


@query(_each([("gelbeseiten", "Wirt am Eck", _OWN, "info@wirt{i}-am-eck.example", "Gelbe Seiten"), ("yelp", "Wirt Berlin {i}", _OWN, "", "Yelp"), ("wko", "Wirt", _OWN, "", "WKO Firmen A-Z")], "scraper_key, name, website, email, snippet"))
def directory_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _over(spark, sf_dir, LISTED, "scraper_key string, url string, html string, page int")
    return directories.entries(lists, _over(spark, sf_dir, DETAILED, "url string, html string"), details=None, per_source=None).select("scraper_key", "name", "website", "email", "snippet")


MAP_PAGES = [
    '<a href="/maps/place/Hotel+A/x" aria-label="Website: www.a{i}.example ">A</a><a href="/maps/place/Hotel+A/y" aria-label="Website: https://z{i}.example">again</a>'
    '<a href="/maps/place/B/x"></a><a href="https://www.google.com/x"></a><a href="https://b{i}.example/"></a>{"/maps/place/C/":{"website":"https://A{i}.example/"}}',
    '<a href="https://www.google.de/x"></a><a href="https://only{i}.example/">x</a>',
]


@query(_each([(1, "Hotel A", "https://www.a{i}.example"), (3, "B", "https://b{i}.example"), (4, "C", "https://A{i}.example"), (1000001, "only{i}.example", "https://only{i}.example")], "ordinal, title, url", len(MAP_PAGES), "ordinal"))
def map_listing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.map_listing_results(_responses(spark, sf_dir, MAP_PAGES)).select("ordinal", "title", "url")


RENDERED = [
    json.dumps({"name": ["", " Hotel A "], "website": [" ", "https://google.com/x"], "website_url": "https://a{i}.example"}),
    json.dumps({"html": "<p>x</p>", "xhr": [{"body": "b1"}, {"response": "b2"}, {"body": ""}], "website": "//b{i}.example"}),
    " <html>bare", "not json", "",
]


@query(_each([(0, "", 0, "https://google.com/x"), (1, "<p>x</p>", 2, "//b{i}.example"), (2, "<html>bare", 0, None), (3, "not json", 0, None), (4, "", 0, None)], "response, html, bodies, website", len(RENDERED), "response"))
def map_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = providers.map_payloads(_responses(spark, sf_dir, RENDERED))
    site = F.get(providers.extracted(F.col("css"), "website", "website_url"), F.lit(0))
    return own.select("response", "html", F.size("bodies").alias("bodies"), site.alias("website"))


@query(_each([(1, "b{i}.example", "https://b{i}.example")], "ordinal, title, url", len(RENDERED), "ordinal").replace("(s_suppkey * 5 + ordinal // 1000000) * 1000000 + ordinal % 1000000", "s_suppkey * 5 + ordinal"))
def map_detail_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _responses(spark, sf_dir, RENDERED).withColumn("place_url", F.lit("x"))
    return providers.map_detail_payloads(own).select("ordinal", "title", "url")


FORMS = ['<form><input name="q"></form><form id=x><input type="hidden" name="q" value="hotel{i}"><input name="s" value="30"/><INPUT name="s" value="60"></form>', "<form><input name='q'></form>"]


@query(_each([(0, "q=hotel{i};s=60"), (1, None)], "response, fields", len(FORMS), "response"))
def ddg_next_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = providers.duckduckgo_form(_responses(spark, sf_dir, FORMS))
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return own.select("response", F.when(F.col("fields").isNotNull(), F.array_join(pairs, ";")).alias("fields"))


LOG = [("{i} timed out",), ("{i}: HTTP Error 503: busy",), ("{i}: HTTP Error 404: no",), ("[WinError 10054] x {i}",), ("Connection refused {i}",), ("http error 500 {i}",), ("ok {i}",)]


@query(
    f"""SELECT message, regexp_matches(lower(message), 'timed out|timeout|temporarily unavailable') OR regexp_matches(message, 'HTTP Error (408|425|429|500|502|503|504):') AS search,
  regexp_matches(lower(message), 'timed out|timeout|connection reset|reset by peer|10054|10053|connection aborted|connection refused|temporarily unavailable|remotehost geschlossen|http error (429|500|502|503|504)') AS directory FROM ({_each(LOG, 'message')})"""
)
def retryable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    return _over(spark, sf_dir, LOG, "message string").select("message", errors.is_retryable_search_error(m).alias("search"), errors.is_transient_directory_error(m).alias("directory"))


_KINDS = ("progress", "site_done", "page", "warning", "lead", "status", "warning")


@query(
    f"""WITH m AS (SELECT user_id AS run, event_id AS ordinal, [{', '.join(f"'{k}'" for k in _KINDS)}][1 + event_id * 13 % 7] AS kind, event_type AS text FROM events),
b AS (SELECT *, kind = 'status' AS barrier, coalesce(sum(CASE WHEN kind = 'status' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM m),
g AS (SELECT run, part, kind, max_by(text, ordinal) AS text, max(ordinal) AS ordinal, count(*) AS n FROM b WHERE NOT barrier AND kind <> 'lead' GROUP BY 1, 2, 3),
d AS (SELECT *, max(CASE WHEN kind = 'site_done' THEN 1 END) OVER (PARTITION BY run, part) AS done FROM g)
SELECT run, ordinal, kind, text FROM b WHERE barrier OR kind = 'lead'
UNION ALL SELECT run, ordinal, kind, CASE WHEN kind = 'warning' AND n > 1 THEN n || 'x, last: ' || text ELSE text END FROM d WHERE NOT (kind = 'progress' AND done IS NOT NULL)"""
)
def message_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") * 13 % 7).cast("int"))
    return messages.coalesced(events.select(F.col("user_id").alias("run"), F.col("event_id").alias("ordinal"), kind.alias("kind"), F.col("event_type").alias("text")))


@query(
    """WITH o AS (SELECT 'https://own' || s_suppkey || '.example' AS url, s_suppkey + 1 AS turn, 0 AS rank FROM supplier),
b AS (SELECT 'https://' || CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE 'other' END || s_suppkey || '.example' AS url, s_suppkey + 1 AS turn, 1 AS rank FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY turn, rank) AS k FROM (SELECT * FROM o UNION ALL SELECT * FROM b))
SELECT url, turn FROM n WHERE k = 1 ORDER BY turn, rank LIMIT 60"""
)
def combined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources by turns, of which one fails: the suppliers, half of them named again by the second, and a source without an answer."""
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").cast("string").alias("i"))
    named = lambda who: lambda: own.select(F.concat(F.lit("https://"), who, "i", F.lit(".example")).alias("url"), "ordinal")

    def fails() -> DataFrame:
        raise OSError("no answer")

    sources = {"osm": named(F.lit("own")), "bing": named(F.when(F.col("ordinal") % 2 == 0, "OWN").otherwise("other")), "brave": fails}
    return search.combined(spark, sources, 60).select("url", "turn")
