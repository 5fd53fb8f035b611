"""Order-flow features from the tape: tick-rule delta, big-trade share, relative volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import div, floor_ts, tf_seconds
from tapeloom.operators.series import DAY, prefix_scan, time_bucket


def tape_features(ticks: DataFrame, tf: str, big_size: int, days: int = 20) -> DataFrame:
    """The tick rule needs the previous price, carried across time buckets of the tape.

    Relative volume compares a slot with the same slot on earlier days: one row per symbol, slot and
    day, so those groups are bounded by the number of days.
    """
    seen = prefix_scan(
        ticks, ["symbol"], ["seq"], time_bucket("ts", 6 * 3600), {"prev": ("last", F.col("price"))}, inclusive=False
    )
    size = F.col("size")
    signed = (
        F.when(F.col("price") > F.col("prev"), size).when(F.col("price") < F.col("prev"), -size).otherwise(F.lit(0))
    )
    per = seen.groupBy("symbol", floor_ts(F.col("ts"), tf_seconds(tf)).alias("ts")).agg(
        F.sum("size").alias("volume"),
        F.sum(signed).alias("delta"),
        F.sum(F.when(size >= big_size, size).otherwise(0)).alias("big"),
    )
    slot = F.pmod(F.unix_seconds("ts"), F.lit(DAY))
    before = Window.partitionBy("symbol", "_slot").orderBy("ts").rowsBetween(-days, -1)
    return (
        per.withColumn("_slot", slot)
        .withColumn("relative_volume", div(F.col("volume"), F.avg("volume").over(before)))
        .withColumn("big_share", div(F.col("big"), F.col("volume")))
        .drop("_slot")
    )
