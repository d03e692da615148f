"""The corpus queries that SQL can express, against it."""

from __future__ import annotations

import pytest
from conftest import assert_same_as_sql

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, data, name):
    assert_same_as_sql(spark, data, queries.QUERIES[name], queries.ORACLE_SQL[name])
