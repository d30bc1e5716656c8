"""Dimension tables: values that other systems fix, and DataFrames of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Parts of hosts of directories, portals and asset servers. A host that holds one isn't a business's own.
HOST_TOKENS = """
gelbeseiten.de dasoertliche.de 11880.com auskunft.de telefonbuch.de dastelefonbuch.de cylex.de cylex-international.com hotfrog.de
hotfrog.com centralindex.com werkenntdenbesten.de goyellow.de wlw.de europages. kompass.com firmenabc. brownbook.net manta.com yalwa.
yelp. meinestadt.de firmenwissen.de branchenbuch.net tripadvisor. booking.com facebook.com instagram.com linkedin.com pinterest.com
google. youtube.com vimeo.com golocal.de treatwell.de treatwell.net ekomi.de consentmanager.net yext-wrap.com holidaycheck. expedia.
googletagservices.com googletagmanager.com google-analytics.com googlesyndication.com doubleclick.net wkdb.h5v.eu h5v.eu
postleitzahlen.de wirfindendeinenjob.de cleverb2b.de cdn.11880.com hrs.de apps.apple.com play.google.com bootstrapcdn.com
cloudfront.net unpkg.com cdnjs.cloudflare.com fonts.googleapis.com gstatic.com schema.org w3.org ogp.me yelpcdn.com yelp.com
manta-r3.com hotjar.com visable.com meinungsmeister.de locanto.de locanto.info cookielaw.org ksales.ai btloader.com crsspxl.com
chivalrouscord.com pitchbook.com pitchbook. indeed.com indeed.de stepstone.de stepstone. arbeitsagentur.de bundesagentur.de
hiringlab.org hrtechprivacy.com deloi.tt adjust.com datadoghq. go-mpulse.net optimizely.com gehalt.de onelink.me indeed.onelink.me
browserupgrade.info jameda.de docplanner. sanego.de restaurantguru.com openstreetmap.org docfinder.at youcanbook.me
anwaltauskunft.de steuerberaterverzeichnis.berufs-org.de verzeichnis-steuerberater.de bstbk.de berufs-org.de herold.at ksv.at
arztsuche24.at firmen.wko.at wko.at kennstdueinen.de
""".split()
# Endings of assets, which are neither hosts nor addresses.
ASSET_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".css", ".js")
# Markers in hosts of the map service.
MAP_HOST_MARKERS = ("google.com", "google.de", "google.at", "gstatic.com", "googleusercontent.com", "ggpht.com", "schema.org", "googleapis.com", "g.page")
# Hints of contact pages, paths to guess, and path prefixes of languages.
CONTACT_HINTS = "contact kontakt impressum imprint legal-notice legal mentions-legales about ueber über team reservierung booking".split()
CONTACT_PATHS = ("/impressum", "/impressum/", "/kontakt", "/kontakt/", "/contact", "/contact/", "/imprint", "/imprint/", "/legal-notice")
LANGUAGE_PREFIXES = "en de fr it es nl pl cs".split()
# Top-level domains that an address put together from tagged text may have.
TRUSTED_TLDS = "de at ch com net org eu info biz io co gmbh berlin hotel reisen shop online email li lu fr it es nl be dk pl cz se no fi uk us ca".split()
# Beginnings of role addresses.
ROLE_PREFIXES = "admin booking contact customerservice hello hilfe info kontakt office reservierung sales service support team vertrieb".split()
# Countries.
COUNTRIES = {"DE": "Deutschland", "AT": "Österreich"}
DEFAULT_COUNTRIES = ("DE",)
# Hints of Austrian places.
AUSTRIAN_HINTS = (
    "wien graz linz salzburg innsbruck klagenfurt villach wels steyr dornbirn bregenz eisenstadt oesterreich österreich austria niederoesterreich "
    "niederösterreich oberoesterreich oberösterreich steiermark tirol kaernten kärnten vorarlberg burgenland"
).split()
# Domains that category searches are narrowed to.
SOURCE_DOMAINS = (
    "gelbeseiten.de dasoertliche.de 11880.com auskunft.de telefonbuch.de dastelefonbuch.de meinestadt.de werkenntdenbesten.de goyellow.de "
    "europages.de kompass.com manta.com wlw.de firmenwissen.de tripadvisor.de yelp.de booking.com"
).split()
# Map tags by category keyword (key=value; a key alone is any value), in order.
OSM_TAGS = """
hotel: tourism=hotel tourism=guest_house tourism=hostel tourism=motel tourism=apartment tourism=chalet
pension: tourism=guest_house tourism=hotel tourism=apartment
restaurant: amenity=restaurant
cafe: amenity=cafe
kaffee: amenity=cafe
bar: amenity=bar amenity=pub
imbiss: amenity=fast_food
baeckerei: shop=bakery
bäckerei: shop=bakery
metzger: shop=butcher
lager: building=warehouse landuse=industrial industrial=warehouse
logistik: office=logistics industrial=logistics landuse=industrial
spedition: office=logistics industrial=logistics
elektronik: shop=electronics
elektriker: craft=electrician
it: office=it office=company
software: office=it office=company
friseur: shop=hairdresser
kosmetik: shop=beauty shop=cosmetics
arzt: amenity=doctors
zahnarzt: amenity=dentist
apotheke: amenity=pharmacy
tierarzt: amenity=veterinary
physio: healthcare=physiotherapist amenity=clinic
auto: shop=car_repair shop=car amenity=car_rental
kfz: shop=car_repair shop=car
werkstatt: shop=car_repair craft
handwerk: craft
maler: craft=painter
tischler: craft=carpenter craft=joiner
schreiner: craft=carpenter craft=joiner
sanitaer: craft=plumber
sanitär: craft=plumber
klempner: craft=plumber
dachdecker: craft=roofer
bau: craft=builder office=construction
immobilien: office=estate_agent
makler: office=estate_agent
anwalt: office=lawyer
rechtsanwalt: office=lawyer
steuerberater: office=tax_advisor office=accountant
versicherung: office=insurance
fitness: leisure=fitness_centre
supermarkt: shop=supermarket
moebel: shop=furniture
möbel: shop=furniture
blumen: shop=florist
florist: shop=florist
optiker: shop=optician
garten: shop=garden_centre craft=gardener
gärtner: craft=gardener shop=garden_centre
gaertner: craft=gardener shop=garden_centre
landschaftsbau: craft=gardener
getraenke: shop=beverages
getränke: shop=beverages
buero: office=company
büro: office=company
firma: office=company
"""
# Search terms by category keyword, the main one first.
VARIANTS = """
logistik: logistik, spedition, transport, lager, fracht, kurier
spedition: spedition, logistik, transport, fracht
transport: transport, spedition, logistik, fracht
lager: lager, logistik, spedition, warehouse
hotel: hotel, gasthof, pension, gästehaus, hostel, motel, aparthotel, landhotel, hotel garni, boardinghouse
pension: pension, gästehaus, gasthof, hotel garni, hotel
restaurant: restaurant, gaststätte, gasthaus, gastronomie, ristorante, trattoria
cafe: café, cafe, kaffeehaus, bistro, kaffeerösterei
bar: bar, kneipe, pub, cocktailbar, weinbar
imbiss: imbiss, schnellrestaurant, döner, fast food, currywurst
baeckerei: bäckerei, backstube, konditorei, backwaren
bäckerei: bäckerei, backstube, konditorei, backwaren
metzger: metzgerei, metzger, fleischerei, schlachterei
supermarkt: supermarkt, lebensmittel, markt, lebensmittelgeschäft
friseur: friseur, friseursalon, haarsalon, coiffeur
kosmetik: kosmetik, kosmetikstudio, beauty, nagelstudio, wellness
fitness: fitness, fitnessstudio, fitnesscenter, sportstudio, gym
arzt: arztpraxis, arzt, hausarzt, facharzt, praxis
zahnarzt: zahnarzt, zahnarztpraxis, zahnmedizin, kieferorthopäde
apotheke: apotheke, pharmazie
tierarzt: tierarzt, tierarztpraxis, tierklinik, veterinär
physio: physiotherapie, physiotherapeut, krankengymnastik, physiopraxis
optiker: optiker, augenoptik, augenoptiker, brillen
handwerk: handwerk, handwerker, meisterbetrieb
elektriker: elektriker, elektro, elektroinstallation, elektrotechnik, elektrobetrieb
maler: maler, malerbetrieb, malermeister, lackierer, maler und lackierer
tischler: tischler, tischlerei, schreiner, schreinerei
schreiner: schreiner, schreinerei, tischler, tischlerei
dachdecker: dachdecker, dachdeckerei, bedachungen, dachbau
sanitaer: sanitär, heizung, shk, installateur, klempner, sanitärbetrieb
sanitär: sanitär, heizung, shk, installateur, klempner, sanitärbetrieb
klempner: klempner, installateur, sanitär, heizung, shk
garten: gartenbau, gärtner, gärtnerei, landschaftsbau, galabau
gärtner: gärtner, gärtnerei, gartenbau, landschaftsbau, galabau
bau: bau, bauunternehmen, baufirma, hochbau, tiefbau, bauträger
immobilien: immobilien, immobilienmakler, makler, immobilienbüro
makler: makler, immobilienmakler, immobilien, immobilienbüro
auto: autohaus, autohändler, kfz, autowerkstatt, fahrzeughandel
kfz: kfz, autowerkstatt, werkstatt, kfz-werkstatt, autohaus
werkstatt: werkstatt, kfz, autowerkstatt, kfz-werkstatt
it: it, software, edv, it-dienstleister, systemhaus
software: software, it, edv, softwareentwicklung, systemhaus
anwalt: rechtsanwalt, anwalt, kanzlei, anwaltskanzlei
rechtsanwalt: rechtsanwalt, anwalt, kanzlei, anwaltskanzlei
steuerberater: steuerberater, steuerkanzlei, steuerbüro, steuerberatung
versicherung: versicherung, versicherungsmakler, versicherungsbüro, versicherungsagentur
moebel: möbel, möbelhaus, einrichtung, möbelgeschäft
möbel: möbel, möbelhaus, einrichtung, möbelgeschäft
blumen: florist, blumen, blumenladen, blumengeschäft, floristik
florist: florist, blumen, blumenladen, blumengeschäft, floristik
elektronik: elektronik, elektronikmarkt, elektrofachmarkt, elektrogeschäft
"""


def _lines(table: str) -> list[tuple[str, str]]:
    return [tuple(x.strip() for x in line.split(":", 1)) for line in table.strip().splitlines()]


def osm_rows() -> list[tuple[int, str, int, str, str]]:
    """(rank of the keyword, keyword, rank in it, key, value)."""
    return [(i, k, j, *(*pair.split("=", 1), "")[:2]) for i, (k, pairs) in enumerate(_lines(OSM_TAGS)) for j, pair in enumerate(pairs.split())]


def variant_rows() -> list[tuple[int, str, int, str]]:
    """(rank of the keyword, keyword, rank in it, term)."""
    return [(i, k, j, t.strip()) for i, (k, terms) in enumerate(_lines(VARIANTS)) for j, t in enumerate(terms.split(","))]


def osm_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(osm_rows(), "rank int, keyword string, place int, tag_key string, tag_value string")


def variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(variant_rows(), "rank int, keyword string, place int, term string")


def values_sql(rows: list[tuple], names: str) -> str:
    """Rows as an SQL VALUES list with column names, for oracles."""

    def one(x: object) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"
