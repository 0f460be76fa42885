"""Every registered query of the feed engine against its SQL counterpart."""

import os

import duckdb
import pytest

from tidemark.plans.catalogue import ORACLES, QUERIES

DATA = os.environ.get("CATALOGUE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    rows = sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    if name not in ORACLES:
        assert rows
        return
    found = oracle.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    at = [found.columns.index(c) for c in sorted(df.columns)]
    expected = sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())
    assert rows == expected
