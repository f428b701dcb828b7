"""Queries that have SQL agree with DuckDB; others run."""

import pytest

from quern.llm import queries

from ..oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    if name in queries.ORACLES:
        compare(df, connect(FOLDER), queries.ORACLES[name])
    else:
        assert df.count() > 0
