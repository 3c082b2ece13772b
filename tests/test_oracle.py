"""Every registered query against its check SQL on the same tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_a_check():
    from leadweave.plans.catalog import QUERIES

    assert set(QUERIES) <= set(CHECKS) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_check(spark, con, sf, name):
    assert compare(spark, con, sf, entry.queries()[name], CHECKS[name]) == ""


def test_entry(spark):
    assert os.path.isdir(entry.SMOKE_DIR)
    assert sum(r.n for r in entry.entry(spark).collect()) > 0
