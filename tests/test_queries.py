"""Every query of the timed-text surface against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from cuelake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return db


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tables, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(repr, map(tuple, got.select(*columns).collect())))
    if name in catalog.ORACLES:
        want = tables.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]}) q").fetchall()
        assert rows == sorted(map(repr, want))
    else:
        assert rows
