"""Every registered query against its DuckDB equivalent, on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
import compare
from corpusflow.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare.compare(spark, con, FOLDER, name)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["query_id", "doc_id", "rank"]
