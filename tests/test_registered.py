"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from listings_spark.checks import registry
from listings_spark.checks.compare import connect, difference

SF = entry.SMOKE_DIR
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_all_queries_have_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


def test_entry_registers_all():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
