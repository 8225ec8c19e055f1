"""Every registered query against its SQL check on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from caselens.plans import load_all
from caselens.plans.registry import ORACLES, QUERIES
from tools.compare import TABLES, compare

load_all()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    line = compare(spark, con, SF, name)
    assert line.startswith(("ok", "rows")), line


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
