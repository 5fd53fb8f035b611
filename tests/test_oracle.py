"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
from tapeloom.catalog.base import REGISTRY

SF = f"{oracle.TESTDATA}/sf0.001"
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_matches_sql(spark, con, key):
    ok, msg, _ = oracle.compare(spark, con, key, REGISTRY[key], SF)
    assert ok is not False, msg


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(REGISTRY) <= set(queries)
    assert {key for key in REGISTRY if key not in sql} == WITHOUT_SQL


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "trades", "profit_factor", "win_rate_pct", "avg_trade_pct"]
    assert df.count() > 0
