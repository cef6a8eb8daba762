"""Every named query against its SQL twin on the whole sample tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from basketry.catalog import QUERIES
from oracle import ORACLE_SQL
from compare import SAMPLES, assert_same, connect

SF_DIR = str(SAMPLES / "sf0.01")


@pytest.fixture(scope="module")
def db():
    with connect(SF_DIR) as connection:
        yield connection


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, name):
    result = contract.queries()[name](spark, SF_DIR)
    assert assert_same(result, db, contract.oracle_sql()[name]) > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 5
