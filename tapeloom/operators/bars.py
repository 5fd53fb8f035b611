"""Ticks to bars, resampling, session anchoring and bar masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import (
    MARKET,
    add_tf,
    asset_class,
    div,
    floor_ts,
    known,
    local,
    local_day,
    local_minute,
    tf_seconds,
    zone,
)
from tapeloom.operators.series import DAY, number_rows, time_bucket

OPEN_MINUTE = 570
CLOSE_MINUTE = 960
LATE_MINUTE = 945


def tick_bars(ticks: DataFrame, tf: str) -> DataFrame:
    """Left-labelled OHLCV bars; empty intervals stay absent. ``seq`` is the tape order."""
    return (
        ticks.withColumn("ts", floor_ts(F.col("ts"), tf_seconds(tf)))
        .groupBy("symbol", "ts")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("size").cast("double").alias("volume"),
            F.count(F.lit(1)).alias("trades"),
        )
    )


def _ohlcv(grouped, ts: str = "_ts") -> DataFrame:
    return grouped.agg(
        F.min_by("open", ts).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", ts).alias("close"),
        F.sum("volume").alias("volume"),
    )


def resample(bars: DataFrame, tf: str) -> DataFrame:
    renamed = bars.withColumn("_ts", F.col("ts")).withColumn("ts", floor_ts(F.col("ts"), tf_seconds(tf)))
    return _ohlcv(renamed.groupBy("symbol", "ts"))


def session_label(ts: Column, tf: str, tz: str = MARKET, anchor_minute: int = OPEN_MINUTE) -> Column:
    """Bar label on the local wall clock, anchored at the session open on every day."""
    wall = local(ts, tz)
    seconds = tf_seconds(tf)
    if seconds >= DAY:
        labelled = F.timestamp_micros(
            F.unix_micros(F.date_trunc("day", wall)) + F.lit(anchor_minute * 60 * 1_000_000)
        )
    else:
        shift = F.lit((anchor_minute * 60 % seconds) * 1_000_000)
        labelled = F.timestamp_micros(
            F.unix_micros(
                floor_ts(F.timestamp_micros(F.unix_micros(wall) - shift), seconds)
            )
            + shift
        )
    return F.to_utc_timestamp(labelled, zone(tz))


def resample_session(bars: DataFrame, tf: str, tz: str = MARKET) -> DataFrame:
    renamed = bars.withColumn("_ts", F.col("ts")).withColumn("ts", session_label(F.col("ts"), tf, tz))
    return _ohlcv(renamed.groupBy("symbol", "ts"))


def resample_vwap(bars: DataFrame, tf: str) -> DataFrame:
    """Bars carrying vwap combine by volume weight."""
    return (
        bars.withColumn("ts", floor_ts(F.col("ts"), tf_seconds(tf)))
        .groupBy("symbol", "ts")
        .agg(
            F.sum("volume").alias("volume"),
            div(F.sum(F.col("volume") * F.col("vwap")), F.sum("volume")).alias("vwap"),
        )
    )


def number_bars(bars: DataFrame, name: str = "bar_no") -> DataFrame:
    """Per-symbol bar position; the bar count per symbol and day is bounded by the timeframe."""
    return number_rows(bars, ["symbol"], ["ts"], time_bucket("ts", 7 * DAY), name)


def rth(bars: DataFrame, tz: str = MARKET) -> DataFrame:
    minute = local_minute(F.col("ts"), tz)
    return bars.where(
        (minute >= OPEN_MINUTE) & (minute < CLOSE_MINUTE) & (F.weekday(local(F.col("ts"), tz)) < 5)
    )


def tag_session(bars: DataFrame, calendar: DataFrame, tz: str = MARKET) -> DataFrame:
    """Session name from a calendar of (day, open_utc, close_utc)."""
    joined = bars.withColumn("day", local_day(F.col("ts"), tz)).join(calendar, "day", "left")
    session = (
        F.when(F.col("open_utc").isNull(), "closed")
        .when(F.col("ts") < F.col("open_utc"), "premarket")
        .when(F.col("ts") >= F.col("close_utc"), "postmarket")
        .otherwise("regular")
    )
    return joined.withColumn("session", session).drop("day", "open_utc", "close_utc")


def session_masks(bars: DataFrame, late_minute: int = LATE_MINUTE, tz: str = MARKET) -> DataFrame:
    """``late`` blocks new entries; ``eod`` marks the last bar of the local day. Coins have neither."""
    day = Window.partitionBy("symbol", "_day")
    stock = asset_class(F.col("symbol").cast("string")) == "stock"
    return (
        bars.withColumn("_day", local_day(F.col("ts"), tz))
        .withColumn("late", (local_minute(F.col("ts"), tz) >= late_minute) & stock)
        .withColumn("eod", (F.col("ts") == F.max("ts").over(day)) & stock)
        .drop("_day")
    )


def completed(bars: DataFrame, tf: str, as_of: Column) -> DataFrame:
    """Only bars whose interval ended by ``as_of``."""
    return bars.where(known(add_tf(F.col("ts"), tf) <= as_of))


def daily_last(series: DataFrame, value: str, keys: list[str], rule_seconds: int = DAY) -> DataFrame:
    """Down-sample to the last value per interval; intervals without a value stay absent."""
    return (
        series.where(F.col(value).isNotNull())
        .withColumn("_ts", F.col("ts"))
        .withColumn("ts", floor_ts(F.col("ts"), rule_seconds))
        .groupBy(*keys, "ts")
        .agg(F.max_by(value, "_ts").alias(value))
    )


def thinned(series: DataFrame, value: str, every: str = "15min") -> DataFrame:
    """The last value of each interval, for every symbol alike."""
    slot = floor_ts(F.col("ts"), tf_seconds(every))
    return series.groupBy("symbol", slot.alias("_slot")).agg(F.max_by(value, "ts").alias(value)).withColumnRenamed("_slot", "ts")
