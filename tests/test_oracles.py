"""Registered queries against DuckDB on whole tables (streams and jobs have tests of their own)."""

import pytest

import __spark_entry__ as entry
from eventmill.catalog.registry import ORACLES, QUERIES
from tools.compare import compare_one, connect

entry.queries()  # fills the registry
BATCH = sorted(n for n in QUERIES if not n.startswith(("str", "job", "snk")))


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", BATCH)
def test_matches_oracle(spark, con, sf_dir, name):
    text, ok = compare_one(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok, text


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_is_the_flagship(spark):
    assert "engagement_score" in entry.entry(spark).columns
