"""The training-data queries against their DuckDB SQL."""

import pytest

from kgspark.llm import queries
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    message, rows = compare(spark, connect(sf), queries.queries()[name](spark, sf), queries.oracle_sql()[name])
    assert message is None and rows > 0
