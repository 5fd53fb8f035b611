"""What the physical plans must and must not contain."""

import oracle
import pytest
from helpers import random_bars, to_spark
from pyspark.sql import functions as F

from tapeloom.catalog.base import REGISTRY
from tapeloom.sources import lake as L
from tapeloom.session import scratch_path

SF = f"{oracle.TESTDATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["barrier_outcome", "fold_trades", "grid_expand", "pnl_corr", "concurrency", "rsi_matrix"])
def test_no_nested_loops(spark, key):
    text = plan(REGISTRY[key].run(spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("key", ["best_per_symbol", "top3_per_symbol", "roster_sync", "concentration"])
def test_top_k_is_cut_before_the_shuffle(spark, key):
    assert "WindowGroupLimit" in plan(REGISTRY[key].run(spark, SF))


def test_scan_reads_two_columns(spark):
    text = plan(REGISTRY["profit_factor"].run(spark, SF))
    assert "l_extendedprice" not in text and "l_shipdate" not in text


def test_lake_prunes_folders_and_pushes_filters(spark):
    path = scratch_path(spark, "lake-test")
    L.write_lake(to_spark(spark, random_bars(200)).withColumn("session", F.lit("regular")), path)
    text = plan(L.read_lake(spark, path, ["A"], "2024-03-02", "regular").select("ts", "close"))
    assert "PartitionFilters" in text and "symbol" in text
    assert "PushedFilters: [IsNotNull(ts), IsNotNull(session), GreaterThanOrEqual(ts" in text
    assert L.lake_symbols(spark, path).count() == 2


def test_lake_write_touches_only_its_partitions(spark):
    path = scratch_path(spark, "lake-test")
    bars = to_spark(spark, random_bars(50)).drop("bar_no")
    L.write_lake(bars, path)
    L.write_lake(bars.where("symbol = 'A'").limit(10), path)
    got = {r.symbol: r["count"] for r in L.read_lake(spark, path).groupBy("symbol").count().collect()}
    assert got == {"A": 10, "B": 50}
