"""The given tables in the roles this engine uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.columns import add_tf
from tapeloom.operators.bars import number_bars, tick_bars
from tapeloom.session import prepare, scratch_path, shared_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str, symbol: str = "event_type") -> DataFrame:
    """Event rows as a trade tape: price is the value, size sits in the JSON payload."""
    return table(spark, sf, "events").select(
        F.col(symbol).cast("string").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("size"),
    )


def bars(spark: SparkSession, sf: str, tf: str, symbol: str = "event_type") -> DataFrame:
    return tick_bars(ticks(spark, sf, symbol), tf)


_LAKE: dict[tuple[str, ...], str] = {}


def numbered(spark: SparkSession, sf: str, tf: str, symbol: str = "event_type") -> DataFrame:
    """The numbered bar table of a timeframe: written to the shared folder once per application, then
    read by everything downstream, as a bar lake would be."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf, tf, symbol)
    if key not in _LAKE:
        path = scratch_path(spark, f"bars-{tf}")
        number_bars(bars(spark, sf, tf, symbol)).write.parquet(path)
        _LAKE[key] = path
    return spark.read.parquet(_LAKE[key])


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as closed trades; returns are whole multiples of 1/100 around zero."""
    entry = F.col("l_shipdate").cast("timestamp")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.concat("l_returnflag", "l_linestatus").alias("cfg"),
        entry.alias("entry_ts"),
        add_tf(entry, "1d", 1).alias("exit_ts"),
        ((F.round(F.col("l_discount") * 100) - 5) / 100).alias("ret"),
        F.col("l_tax").alias("fee"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("notional"),
        F.when(F.col("l_linenumber") % 2 == 1, "long").otherwise("short").alias("side"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as registry rows: one run per order."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("symbol"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderpriority").alias("sweep_tag"),
        F.col("o_orderstatus").alias("strategy"),
        F.col("o_totalprice").alias("metric"),
        F.round(F.col("o_totalprice") / 250000, 2).alias("profit_factor"),
        F.pmod(F.col("o_orderkey"), F.lit(97)).alias("n_trades"),
        F.when(F.pmod(F.col("o_orderkey"), F.lit(2)) == 0, 0.1).otherwise(0.25).alias("fee"),
    )
