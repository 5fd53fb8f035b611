"""Source and sink round trips: rows go out as vendor files and come back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import query, rd, secs, sql
from tapeloom.catalog.bars import CALENDAR, derived_calendar, VWAP_15
from tapeloom.functions.columns import div, floor_ts, ntz, r
from tapeloom.operators.bars import tag_session
from tapeloom.session import scratch_path
from tapeloom.sources import lake as L
from tapeloom.sources.tables import bars, ticks

MINUTE = (
    f"mb AS (SELECT symbol, time_bucket({secs('1min')}, ts) AS ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, "
    "CAST(sum(size) AS DOUBLE) AS volume, count(*) AS trades, sum(price * size) AS qv FROM ticks GROUP BY 1, 2)"
)
OUT = f"symbol, ts, open, high, low, close, volume, trades, {rd('qv / nullif(volume, 0)')} AS vwap"
COLS = ["symbol", "open", "high", "low", "close", "volume", "trades"]


def minute_bars(spark, sf):
    b = bars(spark, sf, "1min")
    t = ticks(spark, sf).groupBy("symbol", floor_ts(F.col("ts"), 60).alias("ts")).agg(
        F.sum(F.col("price") * F.col("size")).alias("qv")
    )
    return b.join(t, ["symbol", "ts"])


def shown(df):
    return df.select(*COLS, ntz(F.col("ts")).alias("ts"), r(F.col("vwap")).alias("vwap"))


@query("kline_parse", sql("ticks", MINUTE, f"SELECT {OUT} FROM mb"))
def kline_parse(spark, sf):
    """Two overlapping exports per symbol, one in milliseconds with headers, one in microseconds."""
    path = scratch_path(spark, "klines")
    b = minute_bars(spark, sf)
    us = F.unix_micros("ts")

    def rows(unit):
        text = [F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")]
        blank = F.lit("0")
        return b.select(
            "symbol",
            (us if unit == "us" else F.floor(us / F.lit(1000))).cast("string").alias("open_time"),
            *[t.alias(c) for t, c in zip(text, ("open", "high", "low", "close", "volume"))],
            blank.alias("close_time"),
            F.col("qv").cast("string").alias("quote_volume"),
            F.col("trades").cast("string").alias("trades"),
            blank.alias("taker_buy_base"),
            blank.alias("taker_buy_quote"),
            blank.alias("ignore"),
        )

    rows("ms").write.partitionBy("symbol").option("header", True).csv(f"{path}/a")
    rows("us").write.partitionBy("symbol").csv(f"{path}/b")
    symbol = F.regexp_extract("_file", "symbol=([^/]+)", 1)
    return shown(L.bronze_klines(spark, f"{path}/*/*", symbol))


@query("json_bars", sql("ticks", MINUTE, f"SELECT {OUT}, 'tape' AS source FROM mb"))
def json_bars(spark, sf):
    """One gzipped document per symbol and day; a day's minutes bound each array."""
    path = scratch_path(spark, "bar-json")
    b = minute_bars(spark, sf).withColumn("vw", div(F.col("qv"), F.col("volume")))
    bar = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"),
        F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
        F.col("volume").alias("v"), F.col("trades").alias("n"), "vw",
    )
    docs = b.groupBy("symbol", F.date_format("ts", "yyyy-MM-dd").alias("month")).agg(
        F.lit("tape").alias("feed"), F.array_sort(F.collect_list(bar)).alias("bars")
    )
    docs.write.option("compression", "gzip").json(path)
    back = L.read_bar_json(spark, path)
    return shown(back).join(back.select("symbol", ntz(F.col("ts")).alias("ts"), "source"), ["symbol", "ts"])


@query("lake_roundtrip", sql("b5m", "SELECT * FROM b5m"))
def lake_roundtrip(spark, sf):
    """Write the partitioned lake twice; the second write replaces the partitions it touches."""
    path = scratch_path(spark, "lake")
    b = bars(spark, sf, "5min")
    L.write_lake(b, path)
    L.write_lake(b, path)
    back = L.read_lake(spark, path)
    return back.select(*COLS, ntz(F.col("ts")).alias("ts"))


@query(
    "lake_scan",
    sql("b15m", CALENDAR,
        f"SELECT symbol, ts, close FROM b15m JOIN c2 ON c2.day = CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE) "
        "WHERE ts >= open_utc AND ts < close_utc AND symbol IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10'"),
)
def lake_scan(spark, sf):
    """Regular-session bars of two symbols from a date on."""
    path = scratch_path(spark, "silver")
    b = bars(spark, sf, "15min")
    L.write_lake(tag_session(b, derived_calendar(b)), path)
    scan = L.read_lake(spark, path, ["click", "view"], "2024-01-10", "regular")
    return scan.select("symbol", ntz(F.col("ts")).alias("ts"), "close")


@query(
    "csv_missing",
    sql("ticks", "d AS (SELECT symbol, date_trunc('day', ts) AS day, round(avg(price), 4) AS close FROM ticks GROUP BY 1, 2)",
        "SELECT symbol, strftime(day, '%Y-%m-%d') AS date, close FROM d WHERE isodow(day) < 6"),
)
def csv_missing(spark, sf):
    """Daily series, one folder per symbol, whose weekend values are the missing marker."""
    path = scratch_path(spark, "series")
    day = ticks(spark, sf).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.round(F.avg("price"), 4).alias("close"))
    text = F.when(F.weekday("date") < 5, F.col("close").cast("string")).otherwise(".")
    day.select("symbol", "date", text.alias("close")).write.partitionBy("symbol").option("header", True).csv(path)
    back = L.read_daily_series(spark, path, by="symbol")
    return back.select("symbol", F.col("date").cast("string").alias("date"), "close")
