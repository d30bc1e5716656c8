"""All directories over pages made from the suppliers: each supplier is a business that every directory lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources import directories

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Businesses of a listing page.
PER_PAGE = 5


@dataclass(frozen=True)
class Pages:
    """Templates of a directory's pages, and of the entry they must give; {i}: a business's number, {p}: its listing page's, {s}: its website."""

    item: str
    source: str
    detail: str = ""
    head: str = ""
    between: str = ""
    tail: str = ""
    name: str = "Wirt {i}"
    website: str = "{s}"
    email: str = ""


SITE = "https://www.wirt{i}.example"
_LD = '<script type="application/ld+json">{"@type":"LocalBusiness","name":"Wirt {i}","url":"%s","sameAs":["{s}"]}</script>'
_JAMEDA = Pages('<a href="https://www.jameda.de/wirt-{i}/arzt/berlin/">x</a>', "https://www.jameda.de/wirt-{i}/arzt/berlin", '<title>Wirt {i} in Berlin | jameda</title><a data-avo-track="doctor-website-link" href="{s}">x</a>')
_DOCFINDER = Pages('<a href="https://www.docfinder.at/arzt/1010-wien/wirt-{i}">x</a>', "https://www.docfinder.at/arzt/1010-wien/wirt-{i}", '<title>Wirt {i} | DocFinder</title><a data-t-action="homepage" data-t-params="{s}">x</a>')
_TREATWELL = Pages('<p>"https://www.treatwell.de/ort/wirt-{i}/"</p>', "https://www.treatwell.de/ort/wirt-{i}/", '<title>Wirt {i} | Treatwell</title>"email":"info@wirt{i}.example"', website="", email="info@wirt{i}.example")
SPEC = {
    "gelbeseiten": Pages('<article class="mod mod-Treffer"><a href="https://www.gelbeseiten.de/gsbiz/{i}"><h2 class="mod-Treffer__name">Wirt {i}</h2></a></article>', "https://www.gelbeseiten.de/gsbiz/{i}", '<title>Wirt {i} | Gelbe Seiten</title><div><i class="contains-icon-big-homepage"></i><a href="{s}">x</a></div>'),
    "das_oertliche": Pages('["","","","{s}","","","","","","","","","","","Wirt {i}","https://www.dasoertliche.de/{i}","",""]', "https://www.dasoertliche.de/{i}", head="<script>var handlerData = [", between=",", tail="];</script>"),
    "telefonbuch": Pages('<div><h3 class="entry name">Wirt {i}</h3><a href="{s}">x</a></div>', "list/telefonbuch/{p}"),
    "11880": Pages('<script type="application/ld+json">{"@type":"LocalBusiness","name":"Wirt {i}","url":"https://www.11880.com/b/{i}","email":"info@wirt{i}.example"}</script>', "https://www.11880.com/b/{i}", '<link itemprop="url" content="{s}">', email="info@wirt{i}.example"),
    "auskunft": Pages('<div class="resultItemContainer"><h2 class="resultHeader"><a href="/firma/wirt-{i}?x=1">Wirt {i}</a></h2><a href="{s}">w</a></div>', "https://www.auskunft.de/firma/wirt-{i}"),
    "cylex": Pages(_LD % "https://www.cylex.de/b/{i}", "https://www.cylex.de/b/{i}"),
    "hotfrog": Pages('<a href="https://www.hotfrog.de/company/{i}">Wirt {i}</a>', "https://www.hotfrog.de/company/{i}", '<h1>Wirt {i}</h1><meta itemprop="url" content="{s}">'),
    "werkenntdenbesten": Pages(_LD % "https://www.werkenntdenbesten.de/b/{i}", "https://www.werkenntdenbesten.de/b/{i}"),
    "goyellow": Pages('<i data-seourl="/home/wirt-{i}--a{i}.html"></i>', "https://www.goyellow.de/home/wirt-{i}--a{i}.html", '<h1 itemprop="name">Wirt {i}</h1><a href="{s}" title="zur Webseite">x</a>'),
    "kompass": Pages('<a href="/c/wirt-{i}/de{i}/">x</a>', "https://de.kompass.com/c/wirt-{i}/de{i}/", '<div><b>Website</b> <a href="{s}">x</a></div>'),
    "europages": Pages('<div class="company-tile"><a href="/de/firma/wirt-{i}">x</a></div>', "https://www.europages.de/de/firma/wirt-{i}", '<script>{"website":"{s}"}</script>'),
    "yelp": Pages('<a href="/biz/wirt-{i}?osq=x">x</a>', "https://www.yelp.de/biz/wirt-{i}", '<a href="/biz_redir?url=https%3A%2F%2Fwww.wirt{i}.example&amp;c=1">x</a>'),
    "manta": Pages('<a href="/c/m{i}/wirt">Wirt {i}</a>', "https://www.manta.com/c/m{i}/wirt", '<script>["a","{s}"]</script>'),
    "pitchbook": Pages('<a href="/profiles/company/{i}-8">x</a>', "https://pitchbook.com/profiles/company/{i}-8", '<title>Wirt {i} GmbH 2026 Company Profile | PitchBook</title><p>Website <a href="{s}">x</a></p>', name="Wirt {i} GmbH"),
    "indeed": Pages('<a href="/cmp/wirt-{i}/faq">x</a>', "https://de.indeed.com/cmp/wirt-{i}", "<title>Beruf und Karriere bei Wirt {i} | Indeed</title><p>unter {s}, hier</p>"),
    "stepstone": Pages('<script>{"companyName":"Wirt {i}","companyUrl":"https://www.stepstone.de/cmp/de/wirt-{i}"}</script>', "https://www.stepstone.de/cmp/de/wirt-{i}/jobs", '<title>12 Aktuelle Jobs bei Wirt {i} | Stepstone</title><script>{"website":"{s}"}</script>'),
    "arbeitsagentur": Pages('{"firma":"Wirt {i}","referenznummer":"{i}-S"}', "https://www.arbeitsagentur.de/jobsuche/jobdetail/{i}-S", '<script id="ng-state">{"arbeitgeberdarstellung":{"firma":"Wirt {i}","links":[{"url":"{s}","art":"Homepage"}]}}</script>', head='<script id="ng-state" type="application/json">{"suchergebnis":{"ergebnisliste":[', between=",", tail="]}}</script>"),
    "jameda": _JAMEDA, "jameda_physio": _JAMEDA, "jameda_zahn": _JAMEDA,
    "sanego": Pages('<a href="/Arzt/Berlin/Arzt/1-a/b/{i}-wirt/">x</a>', "https://www.sanego.de/Arzt/Berlin/Arzt/1-a/b/{i}-wirt/", '<title>Wirt {i}, Arzt in Berlin</title><div class="website"><a href="{s}">x</a></div>'),
    "restaurantguru": Pages('<a href="https://de.restaurantguru.com/Wirt-{i}-Berlin">x</a>', "https://de.restaurantguru.com/Wirt-{i}-Berlin", '<title>Wirt {i}, Berlin</title><a href="{s}">Website</a>'),
    "docfinder": _DOCFINDER, "docfinder_zahn": _DOCFINDER,
    "anwaltauskunft": Pages('{"id":{i},"vorname":"Eva","nachname":"Wirt {i}","organisation":{"internetadresse_1":"www.wirt{i}.example"}}', "https://anwaltauskunft.de/?profile={i}", head='{"data":[', between=",", tail="]}", name="Eva Wirt {i}"),
    "steuerberater": Pages('<option title="Wirt {i}<br>Berlin - Mitte" value="{i}"></option>', "{i}", "<p>www.wirt{i}.example</p>", head='<select name="nachnameOrFirmennameFilter">', tail="</select>", name="Wirt {i} Berlin, Mitte"),
    "herold": Pages('<a href="/gelbe-seiten/wien/Ab{i}C/wirt/" data-ht-label="company_name"><img alt="Logo von Wirt {i}"></a>', "https://www.herold.at/gelbe-seiten/wien/Ab{i}C/wirt/", '<title>Wirt {i} in Wien | herold</title><a href="{s}" data-ht-label="use_other_contact_info">x</a>'),
    "wko": Pages("""<article class='search-result-article'><a class="title-link" href="/wirt-{i}"><h3>Wirt {i}</h3></a><a class='kontaktinfo-web-click' href='{s}'>x</a></article>""", "https://firmen.wko.at/wirt-{i}"),
    "golocal": Pages('<li class="listEntry"><meta itemprop="name" content="Wirt {i}"><h2 class="title"><a href="https://www.golocal.de/berlin/wirt-{i}/">x</a></h2></li>', "https://www.golocal.de/berlin/wirt-{i}/", '<meta itemprop="name" content="Wirt {i}"><a href="{s}" itemprop=url>x</a>'),
    "wlw": Pages('{"item":{"name":"Wirt {i}","url":"https://www.wlw.de/de/firma/wirt-{i}"}}', "https://www.wlw.de/de/firma/wirt-{i}", '<script>{"homepage":"{s}"}</script>', head='<script type="application/ld+json">{"@graph":[{"@type":"ItemList","itemListElement":[', between=",", tail="]}]}</script>"),
    "alibaba": Pages('<a title="Wirt {i}" href="//wirt{i}.en.alibaba.com/company_profile.html">x</a>', "https://wirt{i}.en.alibaba.com/company_profile.html", '<title>Wirt {i} - China</title><script>{"companyHomepage":"{s}"}</script>'),
    "indiamart": Pages('<a href="/company/{i}?x=1">Wirt {i}</a>', "https://export.indiamart.com/company/{i}/", '<title>Wirt {i} | Maker</title><link rel="canonical" href="https://export.indiamart.com/company/{i}/">', website="https://export.indiamart.com/company/{i}/"),
    "made_in_china": Pages('<a href="//wirt{i}.en.made-in-china.com">Wirt {i}</a>', "https://wirt{i}.en.made-in-china.com", website="https://wirt{i}.en.made-in-china.com"),
    "treatwell": _TREATWELL, "treatwell_fitness": _TREATWELL, "treatwell_friseur": _TREATWELL,
}


def _filled(template: Column) -> Column:
    return F.replace(F.replace(F.replace(template, F.lit("{s}"), F.lit(SITE)), F.lit("{i}"), F.col("i")), F.lit("{p}"), F.col("p"))


def _pages(spark: SparkSession, sf_dir: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Listing pages and detail pages of these directories."""
    specs = F.array(*(F.struct(F.lit(k).alias("key"), *(F.lit(getattr(SPEC[k], f)).alias(f) for f in ("head", "item", "between", "tail", "source", "detail"))) for k in keys))
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("n"), F.col("s_suppkey").cast("string").alias("i"), F.floor(F.col("s_suppkey") / PER_PAGE).cast("string").alias("p"))
    own = own.select("n", "i", "p", F.explode(specs).alias("t")).select("n", "i", "p", "t.*")
    each = F.array_sort(F.collect_list(F.struct("n", "between", _filled(F.col("item")).alias("item"))))
    items = F.array_join(F.transform(each, lambda x, k: F.when(k == 0, x["item"]).otherwise(F.concat(x["between"], x["item"]))), "")
    lists = own.groupBy("key", "p").agg(F.concat(F.first("head"), items, F.first("tail")).alias("html"))
    lists = lists.select(F.col("key").alias("scraper_key"), F.concat(F.lit("list/"), "key", F.lit("/"), "p").alias("url"), "html", F.lit(1).alias("page"))
    details = own.filter("detail <> ''").select(_filled(F.col("source")).alias("url"), _filled(F.col("detail")).alias("html")).distinct()
    return lists, details


def _sql(keys: list[str]) -> str:
    """An entry for each supplier and directory, as the templates have it."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    filled = lambda c: f"replace(replace(replace({c}, '{{s}}', '{SITE}'), '{{i}}', CAST(s_suppkey AS VARCHAR)), '{{p}}', CAST(s_suppkey // {PER_PAGE} AS VARCHAR))"
    rows = ", ".join(f"({', '.join(quoted(x) for x in (k, directories.BY_KEY[k].label, SPEC[k].name, SPEC[k].website, SPEC[k].source, SPEC[k].email))})" for k in keys)
    columns = ", ".join(f"{filled('d.' + c)} AS {c}" for c in ("name", "website", "source_url", "email"))
    return f"SELECT d.scraper_key, d.snippet, {columns} FROM supplier, (VALUES {rows}) d(scraper_key, snippet, name, website, source_url, email)"


def _add(name: str, keys: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lists, details = _pages(spark, sf_dir, keys)
        return directories.entries(lists, details, details=None, per_source=None).select("scraper_key", "snippet", "name", "website", "source_url", "email")

    QUERIES[name], ORACLES[name] = run, _sql(keys)


for _key in directories.BY_KEY:
    _add(f"directory_{_key}", [_key])
