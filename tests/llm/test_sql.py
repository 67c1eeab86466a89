"""The training-data queries that SQL can express, against their SQL over whole tables."""

from __future__ import annotations

import pytest

from signal_lake.llm import queries
from tests.conftest import check_against_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    check_against_sql(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])
