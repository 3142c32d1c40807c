"""Corpus queries that have SQL give its rows, column for column."""

import pytest

from colloquy.llm import queries
from tests.test_queries import duck, sorted_rows  # noqa: F401  the fixture

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):  # noqa: F811
    df = queries.queries()[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, result.fetchall())
