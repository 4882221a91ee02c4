"""Registered queries against their SQL at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from contract import check, oracle
from contract.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, name):
    verdict = check.compare(spark, SF, name, QUERIES[name], entry.oracle_sql().get(name))
    assert ": OK " in verdict, verdict


def test_every_query_has_sql():
    assert set(oracle.sql()) == set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
