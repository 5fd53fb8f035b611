"""Structured Streaming: bars from a live tape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import local_day

# Vendor delay, arming age in setup bars, live entry window in local minutes.
WATERMARK = "16 minutes"
ENTRY_OPEN, ENTRY_CUTOFF = 570, 930


def deduped(ticks: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Drop repeats that an overlapping refetch delivers again."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "seq"])


def tumbling_bars(ticks: DataFrame, tf: str) -> DataFrame:
    """Closed bars only: append mode emits a window when the watermark has passed it."""
    return (
        ticks.groupBy("symbol", F.window("ts", tf).alias("w"))
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("size").cast("double").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def session_activity(ticks: DataFrame, gap: str) -> DataFrame:
    """Bursts of activity separated by at least ``gap``."""
    return (
        ticks.groupBy("symbol", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))
        .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "volume")
    )


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process everything that has arrived, write it to ``path`` and return the table."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def risk_guard(opens: DataFrame, ledger: DataFrame, max_open: int, loss_cap: float) -> DataFrame:
    """Block new entries at an instant when too many positions are open or the day lost too much.

    ``opens`` has (key, ts, open_count); ``ledger`` has (key, exit_ts, pnl). Losses are those booked
    earlier on the same local day or at that instant.
    """
    day = lambda c: local_day(F.col(c))
    booked = ledger.groupBy("key", F.col("exit_ts").alias("ts")).agg(F.sum("pnl").alias("pnl"))
    timeline = (
        opens.withColumn("is_open", F.lit(True))
        .join(booked, ["key", "ts"], "full")
        .withColumn("day", day("ts"))
    )
    so_far = Window.partitionBy("key", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = timeline.withColumn("day_pnl", F.coalesce(F.sum("pnl").over(so_far), F.lit(0.0))).where("is_open")
    reason = F.when(F.col("open_count") > max_open, "max open positions").when(
        F.round("day_pnl", 9) <= -loss_cap, "daily loss"
    )
    return out.select("key", "ts", "open_count", "day_pnl", reason.alias("blocked"))
