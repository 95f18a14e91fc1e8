"""Every registered query of the engine against its SQL; those without SQL must run and have rows."""

import pytest

from kgspark import registry
from tests.oracle import compare, connect

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    message, rows = compare(spark, con, registry.queries()[name](spark, sf), SQL[name])
    assert message is None and rows > 0


def test_columns_are_named(spark, sf):
    for name in ("entity_degree_topk",):
        df = registry.queries()[name](spark, sf)
        assert df.columns == ["id", "degree"] and df.count() == 20


def test_interpretations_round_as_sql(spark, tmp_path):
    """Balances whose scaled value lies halfway between two thousandths."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT 1 + 35 * i + j AS c_custkey, CASE WHEN j = 0 THEN 10 * i + 5 ELSE -(10 * i + 5) END::DOUBLE AS c_acctbal FROM range(1000) a(i), range(2) b(j)")
    con.execute(f"COPY customer TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    message, rows = compare(spark, con, registry.queries()["interpretations"](spark, str(tmp_path)), SQL["interpretations"])
    assert message is None and rows == 2000
