"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from candlewick.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return db


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*(table[c].to_pylist() for c in names), strict=True)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = rows(catalog.QUERIES[name](spark, FOLDER).toArrow())
    assert got == rows(duck.sql(catalog.ORACLES[name]).to_arrow_table())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
