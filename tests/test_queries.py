"""Every query of the engine against its DuckDB twin, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from gleaner import catalog

SF = Path(os.environ.get("GLEANER_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF / t}.parquet'")
    return con


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in catalog.ORACLES:
        own = duck.execute(catalog.ORACLES[name])
        names = [x[0] for x in own.description]
        assert sorted(names) == columns
        assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in own.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    if SF.exists():
        assert "email" in __spark_entry__.entry(spark).columns
