"""URL and text rules, landed pages, sinks, crawls and streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner import sinks
from gleaner.functions import html, text, urls
from gleaner.operators import crawl
from gleaner.plans import planning
from gleaner.sources import providers, search, snapshots


def column(spark, values, f):
    rows = [(i, v) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, v string").select("i", f(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(got, key=lambda r: r.i)]


URLS = ["https://WWW.A.de/X//", " b.de/x ", "ftp://c.de", "", "https://user@d.de:8080/p#f", "https://e.de?q=1", "not a url with spaces", "//f.de", "mailto:x@y.de"]


def test_url_rules(spark):
    assert column(spark, URLS, urls.url_key)[0] == "https://www.a.de/x"
    assert column(spark, URLS, urls.host) == ["a.de", "", "c.de", "", "user@d.de:8080", "e.de", "", "f.de", ""]
    assert column(spark, URLS, urls.is_web_url) == [True, False, False, False, True, True, False, False, False]
    assert column(spark, URLS, urls.normalize_url)[:4] == ["https://WWW.A.de/X//", "https://b.de/x", "", ""]
    assert column(spark, ["https://a.de/x#y#z", "x"], urls.strip_fragment) == ["https://a.de/x", "x"]
    assert column(spark, ["https://a.de/", "https://google.de/x", "https://notgoogle.com", "a.png", "x.example"], urls.is_external_business_url) == [True, False, False, False, True]
    assert column(spark, ["//a.de/", "https://www.google.com/x", "b.de//", ""], urls.normalize_map_website) == ["https://a.de", "", "https://b.de", ""]
    assert column(spark, ["https://www.google.com/maps/place/A+%26+B/@1", "x", None], urls.place_name) == ["A & B", "", ""]
    keys = spark.createDataFrame([(" https://A.de// ", "x@y", "s", "t"), ("", " X@Y ", "s", "t"), ("", "", "S/ ", "t"), (" ", "", "", " T "), ("", "", "", "")], "u string, e string, s string, t string")
    assert [r.k for r in keys.select(urls.crawl_key(F.col("u"), F.col("e"), F.col("s"), F.col("t")).alias("k")).collect()] == ["https://a.de", "directory-email:x@y", "directory-source:s", "directory-title:t", "directory-empty"]
    assert column(spark, ["https://a.de/EN/x", "https://a.de/xy", "nothing"], lambda c: F.size(urls.guessed_contact_urls(c))) == [18, 9, 0]


def test_addresses_are_as_the_sql_finds_them(spark):
    """Letters beyond ASCII end words, no-break spaces aren't spaces, and cases fold, as in the SQL's engine."""
    import duckdb

    texts = ["ihr at haen.\nEnödf", "ópf.@thened.therator", "éa.b@c.de_x", "a@b.cd-e@f.gh", "a@b.cd.e@f.gh", "x\u00a0@ b.de", "\u017fa@b.de\u017f", "max@\u212a.com1", "a\u000b@b.de", "._a@b.de9", "m_%@x.co.é"]
    sql = f"SELECT regexp_extract_all(?, '{text.EMAIL_PATTERN}', 0, 'i')"
    want = [duckdb.execute(sql, [t]).fetchone()[0] for t in texts]
    assert want[:2] == [["ihr at haen.\nEn"], ["pf.@thened.therator"]]
    assert column(spark, texts, lambda c: F.regexp_extract_all(c, F.lit(text.RE2_EMAIL), F.lit(0))) == want
    assert [html.page_emails(t) for t in texts] == [sorted({html.clean_email(m) for m in w}) for w in want]
    assert column(spark, texts[:2], text.emails) == [["ihr@haen.en"], ["pf.@thened.therator"]]


def test_url_rules_do_not_repeat_their_inputs(spark):
    """A rule over a rule parses a URL a fixed number of times, whatever the tokens; before, the plan named the parsing 35 times, and again for each token."""
    own = spark.createDataFrame([(0, "a.de"), (1, None), (2, "https://www.yelp.de/x")], "i int, u string").select("i", urls.is_external_business_url(urls.normalize_url(F.col("u"))).alias("x"))
    assert own._jdf.queryExecution().analyzed().toString().count("parse_url") <= 3
    assert [r.x for r in own.orderBy("i").collect()] == [True, False, False]


def test_text_rules(spark):
    mails = column(spark, ["Max [at] x (dot) de, <B@y.com>. logo@2x.png b@Y.com", "", "a @ b.de"], text.emails)
    assert mails == [["b@y.com", "max@x.de"], [], ["a@b.de"]]
    assert column(spark, ["first at hees. The", "a@b.de"], text.strict_emails) == [[], ["a@b.de"]]
    assert column(spark, ["Tel +49 30  1234\n5678 x", "12", "0049301234567"], text.phone) == ["+49 30 1234 5678", "", "0049301234567"]
    assert column(spark, ["3.769.962", " 9954 ", "unknown", "1 000", ""], text.population) == [3769962, 9954, None, 1000, None]
    assert column(spark, ["E-Mail: A@b.de", "mailto:x@y.example", "a@b", "@b.de", None], text.directory_email) == ["a@b.de", "x@y.example", "", "", ""]
    assert column(spark, ["Wien", "AT", "Berlin", "Großgraz", "Weltsteyr"], text.is_austrian) == [True, True, False, True, True]
    assert column(spark, ["/home/hotel-am-eck--a1.html", "/biz/x-y/", "wirt"], text.name_from_slug) == ["Hotel Am Eck", "X Y", "Wirt"]
    assert column(spark, ["a b/ä", "x"], text.path_slug) == ["a%20b%2F%C3%A4", "x"]
    names = spark.createDataFrame([("Wirt - Berlin | x", "a.de"), ("Coca-Cola", "a.de"), ("", "a.de")], "t string, h string")
    assert [r.n for r in names.select(text.company_name(F.col("t"), F.col("h")).alias("n")).collect()] == ["Wirt", "Coca", "a.de"]
    asked = spark.createDataFrame([("hotel", "Berlin"), ("hotel", "")], "c string, l string")
    assert [tuple(r) for r in asked.select(text.build_query(F.col("c"), F.col("l")), text.build_query(F.col("c"), F.col("l"), True)).collect()] == [("hotel Berlin Unternehmen Kontakt E-Mail", "hotel Berlin"), ("hotel Unternehmen Kontakt E-Mail", "hotel")]


def test_pages_of_many_spellings():
    assert html.page_emails("a&#64;b.de <!-- x --> c<b>@</b>d.com e<i></i>@f.zz") == ["a@b.de", "c@d.com"]
    assert html.parse_page("<TITLE>x</title><a HREF='/Kontakt'>k</a>", "https://a.de/b") == ("x", ["https://a.de/Kontakt"])
    assert html.parse_page("", "") == ("", [])


def test_readable_pages(spark):
    rows = [("https://a.de/x", "text/html; charset=utf-8", 200, "<p>" * 10), ("https://a.de/private/y", "text/html", 200, "y"), ("https://b.de/", "application/pdf", 200, "z"), ("https://c.de/", "TEXT/HTML", 404, "z"), ("https://d.de", "text/html", None, None)]
    pages = spark.createDataFrame(rows, "url string, content_type string, status int, html string")
    robots = spark.createDataFrame([("a.de", "User-agent: *\nDisallow: /private"), ("d.de", "")], "host string, text string")
    got = {r.url: r.html for r in snapshots.readable(pages, robots, 6).collect()}
    assert got == {"https://a.de/x": "<p><p>", "https://d.de": None}
    wide = spark.createDataFrame([("https://e.de/", "text/html", 200, "aé" * 5)], pages.schema)
    assert snapshots.readable(wide, robots, 5).collect()[0].html == "aéa\N{REPLACEMENT CHARACTER}"


def test_robots_rules_by_agent(spark):
    text = "# closed\nUser-agent: gleaner\nAllow: /open/in\nDisallow: /open\n\nUser-agent: *\nDisallow: /\n"
    robots = spark.createDataFrame([("A.de", text), ("b.de", "User-agent: *\nDisallow:"), ("b.de", "User-agent: *\nDisallow: ")], "host string, text string")
    rows = ["https://a.de/", "https://www.a.de/open/x", "https://a.de/open/in/x", "http://b.de/x", "https://c.de/open", None]
    pages = spark.createDataFrame([(u, i) for i, u in enumerate(rows)], "url string, n int")
    read = lambda agent: sorted(r.n for r in snapshots.permitted(pages, robots, agent).collect())
    assert read("gleaner") == [0, 2, 3, 4, 5] and read("another") == [3, 4, 5]
    assert snapshots.permitted(pages, robots.limit(0)).count() == 6


def test_crawl_of_a_site(spark):
    pages = spark.createDataFrame(
        [
            ("https://www.hotel.de/", "<title>Hotel - Berlin</title><a href='/about-us'>x</a> max@hotel.de info@hotel.de"),
            ("https://www.hotel.de/about-us", "sales@hotel.de info@hotel.de"),
            ("https://www.hotel.de/impressum", "<title>Impressum</title> kontakt@hotel.de"),
            ("https://closed.de/", "info@closed.de"),
            ("https://www.hotel.de/impressum", "<title>Zweitfassung</title> zweite@hotel.de"),
            ("https://www.hotel.de/rooms", "never-reached@hotel.de"),
        ],
        "url string, html string",
    )
    results = spark.createDataFrame(
        [("www.hotel.de/", "T", "snip", "", "", 0), ("https://closed.de/", "C", "", "fallback-info@closed.de", "dir", 1), ("", "D", "", "office@d.de", "src", 2), ("", "E", "", "max@e.de", "src", 3), ("https://missing.de", "M", "", "", "", 4)],
        "url string, title string, snippet string, directory_email string, directory_source_url string, ordinal long",
    )
    robots = spark.createDataFrame([("closed.de", "User-agent: *\nDisallow: /")], "host string, text string")
    got = crawl.crawl(results.withColumn("url", F.when(F.col("url") == "www.hotel.de/", "https://www.hotel.de/").otherwise(F.col("url"))), pages, robots, "hotel").collect()
    leads = {(r.ordinal, r.email, r.website, r.company_name, r.page_title) for r in got}
    assert leads == {
        (0, "info@hotel.de", "https://www.hotel.de/", "Hotel", "Hotel - Berlin"), (0, "sales@hotel.de", "https://www.hotel.de/about-us", "Hotel", "Hotel - Berlin"),
        (0, "kontakt@hotel.de", "https://www.hotel.de/impressum", "Impressum", "Impressum"), (2, "office@d.de", "", "D", "D"),
    }
    few = crawl.crawl(results.filter("ordinal = 0").withColumn("url", F.lit("https://www.hotel.de/")), pages, robots, "hotel", max_pages=1, include_personal=True).collect()
    assert sorted(r.email for r in few) == ["info@hotel.de", "max@hotel.de"]


def test_sinks(spark, tmp_path):
    leads = spark.createDataFrame([("hotel", "s", "w", "a@b.de", 'A "B", C', "1", "t", "business_public", ["x", "y"])], "category string, source_url string, website string, email string, company_name string, phone string, page_title string, consent_status string, notes array<string>")
    leads = leads.withColumn("discovered_at", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    sinks.write_csv(leads, f"{tmp_path}/csv")
    sinks.write_csv(leads, f"{tmp_path}/csv", "append")
    own = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").collect()
    assert len(own) == 2 and own[0].asDict() == {"category": "hotel", "company_name": 'A "B", C', "email": "a@b.de", "website": "w", "source_url": "s", "page_title": "t", "consent_status": "business_public", "notes": "x; y", "discovered_at": "2024-05-06T07:08:09+00:00"}
    sinks.write_json(leads, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").first().phone == "1"


def test_seeds_and_terms(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# c\nhttps://a.de\n\n https://b.de \nhttps://c.de\n")
    assert [r.url for r in providers.seeds(spark, f"{tmp_path}/s.txt", 2).collect()] == ["https://a.de", "https://b.de"]
    assert [r.term for r in providers.terms(spark, f"{tmp_path}/s.txt").collect()] == ["https://a.de", "https://b.de", "https://c.de"]
    (tmp_path / "e.txt").write_text("# only\n")
    with pytest.raises(ValueError):
        providers.terms(spark, f"{tmp_path}/e.txt")
    with pytest.raises(Exception):
        providers.seeds(spark, f"{tmp_path}/missing.txt").collect()


def test_fallback_to_places(spark):
    elements = spark.createDataFrame([(0, json.dumps({"elements": [{"tags": {"website": "a.de"}}]})), (1, json.dumps({"elements": []}))], "response long, payload string")
    places = spark.createDataFrame([(0, json.dumps([{"name": "P", "extratags": {"website": "p.de"}}])), (1, json.dumps([{"name": "Q", "extratags": {"website": "q.de"}}, {"name": "A", "extratags": {"website": "https://a.de/"}}]))], "response long, payload string")
    assert sorted(r.url for r in providers.osm_with_fallback(elements, places).collect()) == ["https://a.de", "https://q.de"]


def test_budgets():
    assert [planning.page_depth(n, True) for n in (30, 31, 150, 151)] == [90, 40, 40, 10] and planning.page_depth(999, False) == 90
    assert [planning.places_per_city(n, p) for n, p in ((100, 0), (100, 2), (10, 5), (9999, 10))] == [25, 55, 10, 60]
    assert [planning.per_location_limit(n, k) for n, k in ((50, 10), (5000, 10), (300, 10))] == [50, 500, 100]
    assert [planning.per_source_limit(n, k, s) for n, k, s in ((50, 10, 8), (5000, 1, 8), (5000, 1, 2))] == [10, 120, 120]


def test_streams(spark, tmp_path):
    from gleaner.streaming import accepting

    def land(i, rows):
        pd.DataFrame(rows, columns=["ordinal", "email"]).to_parquet(tmp_path / f"{i}.parquet", index=False)

    folder = tmp_path / "in"
    folder.mkdir()
    tmp_path = folder
    land(0, [(0, "a@x.de"), (1, "A@x.de "), (2, "b@y.de"), (3, "out@z.de")])
    land(1, [(4, "a@x.de"), (5, "c@x.de"), (6, ""), (7, "d@led.de"), (8, "e@w.de")])
    stream = spark.readStream.schema("ordinal long, email string").option("maxFilesPerTrigger", 1).parquet(str(folder))

    def collected(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = collected(accepting.dedupe_stream(stream), "deduped")
    assert sorted(r.email.strip().lower() for r in got) == ["a@x.de", "b@y.de", "c@x.de", "d@led.de", "e@w.de", "out@z.de"]
    out = str(folder.parent / "csv")
    empty = {c: F.lit("") for c in ("category", "company_name", "website", "source_url", "page_title", "consent_status")}
    q = accepting.write_stream(stream.withColumns(empty), out, str(folder.parent / "cp"))
    q.awaitTermination(120)
    assert spark.read.option("header", True).csv(out).count() == 9
    # A batch that is played again, as after a crash before its commit, replaces its rows.
    for commit in (folder.parent / "cp" / "commits").glob("*"):
        commit.unlink()
    accepting.write_stream(stream.withColumns(empty), out, str(folder.parent / "cp")).awaitTermination(120)
    assert spark.read.option("header", True).csv(out).count() == 9


def test_domain_ledger_state():
    """The state's rule, batch by batch: the first lead of a domain is accepted, later ones are known."""
    from gleaner.streaming.accepting import _DomainLedger

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def update(self, v):
            self.held = v

    own = _DomainLedger()
    own.taken = Value()
    frame = lambda *rows: pd.DataFrame(rows, columns=["ordinal", "email"])
    batch = lambda *frames: {r.email: r.verdict for f in own.handleInputRows(("x.de",), iter(frames), None) for r in f.itertuples()}
    assert batch(frame((5, "a@x.de"), (3, "b@x.de")), frame(), frame((4, "d@x.de")), frame((2, "e@x.de"), (2, "f@x.de"))) == dict.fromkeys(["a@x.de", "b@x.de", "d@x.de", "f@x.de"], "known") | {"e@x.de": "accepted"}
    assert batch(frame((1, "c@x.de"))) == {"c@x.de": "known"}


def test_a_source_that_fails_while_read(spark):
    good = spark.createDataFrame([("https://a.de", 1)], "url string, ordinal long")
    bad = good.withColumn("url", F.raise_error(F.lit("gone")).cast("string"))
    told = []
    got = search.combined(spark, {"osm": lambda: bad, "duckduckgo": lambda: good}, 5, told.append).collect()
    assert [r.url for r in got] == ["https://a.de"] and len(told) == 1 and told[0].startswith("osm:")
    with pytest.raises(ValueError, match="osm: .*; duckduckgo: "):
        search.combined(spark, {"osm": lambda: bad, "duckduckgo": lambda: bad}, 5)
