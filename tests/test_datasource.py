"""A search of one's own, and the ledger over a stream."""

import pandas as pd
import pytest

from gleaner.sources.datasource import SearchSource


def find(category, location, limit):
    for i in range(limit + 3):
        yield {"title": f"{category} {i}", "url": f"https://{location.lower()}-{i}.example", "snippet": None}


def test_search_source(spark):
    spark.dataSource.register(SearchSource)
    read = spark.read.format("gleaner_search").option("search", "tests.test_datasource:find").option("category", "hotel").option("locations", "Berlin; Bonn").option("limit", 2)
    rows = read.load().orderBy("ordinal").collect()
    assert [(r.url, r.title, r.snippet, r.ordinal) for r in rows] == [
        ("https://berlin-0.example", "hotel 0", "", 0), ("https://berlin-1.example", "hotel 1", "", 1), ("https://bonn-0.example", "hotel 0", "", 1_000_000), ("https://bonn-1.example", "hotel 1", "", 1_000_001),
    ]
    with pytest.raises(Exception, match="search"):
        spark.read.format("gleaner_search").load().collect()


def logged(category, location, limit):
    """Leaves a file for each location asked."""
    from pathlib import Path

    Path(category, location).write_text("asked")
    yield {"url": f"https://{location}.example"}


def test_filters_leave_out_locations(spark, tmp_path):
    spark.dataSource.register(SearchSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for k, (condition, want) in enumerate(
            [("ordinal = 1000000", {"B"}), ("ordinal >= 1000000", {"B", "C"}), ("ordinal < 1000000", {"A"}), ("ordinal in (0, 2000000)", {"A", "B", "C"}), ("ordinal > 5000000", set()), ("title = ''", {"A", "B", "C"})]
        ):
            folder = tmp_path / str(k)
            folder.mkdir()
            read = spark.read.format("gleaner_search").option("search", "tests.test_datasource:logged").option("category", str(folder)).option("locations", "A;B;C").option("pushdown", "true").load()
            rows = {r.url for r in read.filter(condition).collect()}
            assert {p.name for p in folder.iterdir()} == want
            assert rows == ({"https://A.example", "https://C.example"} if "in (" in condition else {f"https://{x}.example" for x in want})
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_stream_goes_on_with_new_locations(spark, tmp_path):
    spark.dataSource.register(SearchSource)
    for folder in ("asked", "again"):
        (tmp_path / folder).mkdir()

    def run(locations, folder):
        read = spark.readStream.format("gleaner_search").option("search", "tests.test_datasource:logged").option("category", str(tmp_path / folder)).option("locations", locations)
        q = read.load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run("A;B", "asked")
    run("A;B;C;D", "again")
    assert {p.name for p in (tmp_path / "asked").iterdir()} == {"A", "B"} and {p.name for p in (tmp_path / "again").iterdir()} == {"C", "D"}
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"https://{x}.example" for x in "ABCD"]


def test_ledger_stream(spark, tmp_path):
    from gleaner.streaming import accepting

    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        pd.DataFrame([(0, "a@x.de"), (1, "b@x.de"), (2, "c@out.de"), (3, "d@led.de"), (4, "e@y.de")], columns=["ordinal", "email"]).to_parquet(tmp_path / "in/0.parquet", index=False)
        pd.DataFrame([(5, "f@x.de"), (6, "g@z.de")], columns=["ordinal", "email"]).to_parquet(tmp_path / "in/1.parquet", index=False)
        stream = spark.readStream.schema("ordinal long, email string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        entries = lambda *xs: spark.createDataFrame([(x,) for x in xs], "entry string")
        out = accepting.ledger_stream(stream, entries("out.de"), entries("@led.de"))
        q = out.writeStream.format("memory").queryName("ledger").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        got = {r.ordinal: r.verdict for r in spark.table("ledger").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {0: "accepted", 1: "known", 4: "accepted", 5: "known", 6: "accepted"}
