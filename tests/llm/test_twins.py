"""Queries that SQL can express, against their twins on the smallest tables."""

import pytest

from listings_spark.checks.compare import connect, difference
from listings_spark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_twin(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_returns_every_row(spark, name):
    source, rows = ("embeddings", 32) if name == "op12_whitening" else ("documents", 1)
    assert QUERIES[name](spark, SF).count() == rows * spark.read.parquet(f"{SF}/{source}.parquet").count()
