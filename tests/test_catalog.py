"""Every query of the catalogue against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from logweave.plans import catalog, explorer  # noqa: F401

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(t[i]) for i in order) for t in tuples)


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, duck, name):
    found, expected = catalog.QUERIES[name](spark, SMALL), duck.sql(catalog.SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())
