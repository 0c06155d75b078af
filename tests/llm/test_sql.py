"""Queries with SQL against DuckDB."""

import pytest
from compare import connect, differences

from pulsegrid.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, DIR), queries.ORACLE_SQL[name], connect(DIR)) == ""
