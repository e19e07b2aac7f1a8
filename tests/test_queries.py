"""Every registered query beside its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql
from compare import TABLES, compare
from daykeeper.plans.catalog import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


#: Queries that find nothing in the smallest tables.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def connection():
    db = duckdb.connect()
    for table in TABLES.split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return db


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    problem = compare(spark, connection, name, SF)
    assert problem == ("no rows" if name in EMPTY else None)


def test_entry_runs(spark):
    assert entry(spark).count() > 0
