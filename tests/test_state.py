"""Runs that stop and go on, and searches over several sources."""

import pytest

from gleaner.sources import search
from gleaner.state import RunState, baseline, every

SETTINGS = {"category": "hotel", "location": "", "countries": ["DE"], "limit": 50, "max_leads": 0, "dedupe_by": "email"}


def test_state_goes_on(spark, tmp_path):
    own = RunState(spark, f"{tmp_path}/run")
    assert own.begin(**SETTINGS) is False and RunState(spark, own.path).begin(**SETTINGS) is True
    with pytest.raises(ValueError, match="limit"):
        own.begin(**SETTINGS | {"limit": 99})
    assert own.read("crawled", "key string").count() == 0
    own.append("crawled", spark.createDataFrame([("a",)], "key string"))
    own.append("crawled", spark.createDataFrame([("b",)], "key string"))
    own.append("completed_locations", spark.createDataFrame([("Berlin",)], "location string"))
    assert sorted(r.key for r in own.read("crawled", "key string").collect()) == ["a", "b"]
    assert own.counts() == {"search_results": 0, "crawled": 2, "completed_plans": 0, "completed_locations": 1, "leads": 0}
    assert own.summary(False, partial=7) == "7 websites, 2 crawled, 0 leads, 1 locations, search goes on" and own.summary(True) == "0 websites, 2 crawled, 0 leads"
    with pytest.raises(ValueError):
        own.append("other", spark.range(1))
    leads = spark.createDataFrame([("business_public",), ("personal_review_required",)], "consent_status string")
    assert tuple(baseline(leads).first()) == (2, 1, 1)
    assert [every(n) for n in (0, 999, 1000, 4999, 5000)] == [10, 10, 150, 150, 500]


def test_sources_asked():
    assert search.asked({}) == ["osm", "duckduckgo", "directories"]
    assert search.asked({"bing": "k", "google": "k", "brave": ""}) == ["osm", "duckduckgo", "directories", "google", "bing"]
    assert search.asked({}, "maps") == ["maps"]
    with pytest.raises(ValueError):
        search.asked({}, "nowhere")


def test_directory_search_goes_on(spark):
    row = '<a href="//{0}.en.made-in-china.com">{0} Ltd</a>'
    pages = spark.createDataFrame([("made_in_china", f"u{i}", row.format(f"firm{i}"), p, town) for i, (p, town) in enumerate([(1, "Berlin"), (1, "Bonn"), (9, "Bonn")])], "scraper_key string, url string, html string, page int, location string")
    details = spark.createDataFrame([], "url string, html string")
    got = search.directory_search(pages, details, 10).collect()
    assert sorted(r.title for r in got) == ["firm0 Ltd", "firm1 Ltd"]
    done = spark.createDataFrame([("Berlin",)], "location string")
    assert [r.title for r in search.directory_search(pages, details, 10, done).collect()] == ["firm1 Ltd"]


def test_site_rows_share_the_limit(spark):
    rows = [(d, i, f"https://{d}-{i % 3}.example") for d in range(2) for i in range(6)]
    got = search.site_rows(spark.createDataFrame(rows, "domain_rank int, ordinal int, url string"), 34).collect()
    assert [(r.domain_rank, r.ordinal) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_no_source(spark):
    told = []

    def fails():
        raise OSError("down")

    with pytest.raises(ValueError):
        search.combined(spark, {"osm": fails}, 5, told.append)
    assert told == ["osm: down"] and search.combined(spark, {"osm": fails}, 0).count() == 0
