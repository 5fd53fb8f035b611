"""Raw vendor files to bar tables and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.columns import div
from tapeloom.operators.quality import keep_first

# The twelve columns of a kline file, all read as text.
KLINE_COLUMNS = [
    "open_time",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "close_time",
    "quote_volume",
    "trades",
    "taker_buy_base",
    "taker_buy_quote",
    "ignore",
]
KLINE_SCHEMA = ", ".join(f"`{c}` string" for c in KLINE_COLUMNS)
BAR_JSON_SCHEMA = (
    "symbol string, month string, adjustment string, feed string, fetched_at string, pages int, "
    "bars array<struct<t:string,o:double,h:double,l:double,c:double,v:double,n:bigint,vw:double>>"
)


def epoch_ts(text: Column) -> Column:
    """Milliseconds or, above 10^15, microseconds since the epoch."""
    t = text.cast("long")
    return F.timestamp_micros(F.when(t > 1_000_000_000_000_000, t).otherwise(t * 1000))


def read_klines(spark: SparkSession, path: str, symbol: Column) -> DataFrame:
    """Kline CSV files with or without a header row, any mix in one folder.

    ``symbol`` is an expression over the row and ``_file``, the file it came from.
    """
    raw = spark.read.schema(KLINE_SCHEMA).csv(path).withColumn("_file", F.col("_metadata.file_path"))
    rows = raw.where(F.col("open_time").rlike("^[0-9]+$"))
    number = {c: F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume", "quote_volume")}
    typed = rows.select(
        epoch_ts(F.col("open_time")).alias("ts"),
        symbol.alias("symbol"),
        *[v.alias(c) for c, v in number.items()],
        F.col("trades").cast("long").alias("trades"),
        F.lit("kline").alias("source"),
        "_file",
    )
    return typed.withColumn("vwap", div(F.col("quote_volume"), F.col("volume"))).drop("quote_volume")


def bronze_klines(spark: SparkSession, path: str, symbol: Column) -> DataFrame:
    """One row per symbol and minute: the first in file-name order wins."""
    typed = read_klines(spark, path, symbol)
    tie = ["_file", "open", "high", "low", "close", "volume", "trades"]
    return keep_first(typed, ["symbol", "ts"], tie).drop("_file")


def read_bar_json(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped payloads, one object per symbol and month with a ``bars`` array."""
    doc = spark.read.schema(BAR_JSON_SCHEMA).json(path)
    b = F.col("b")
    return doc.select("symbol", F.col("feed").alias("source"), F.explode("bars").alias("b")).select(
        "symbol",
        F.to_timestamp(b["t"]).alias("ts"),
        b["o"].alias("open"),
        b["h"].alias("high"),
        b["l"].alias("low"),
        b["c"].alias("close"),
        b["v"].alias("volume"),
        b["n"].alias("trades"),
        b["vw"].alias("vwap"),
        "source",
    )


def write_lake(bars: DataFrame, path: str, months_per_task: int = 3) -> None:
    """Partition by symbol and year, rebuilding only the partitions present in ``bars``.

    A busy symbol's year is cut by month groups between tasks, and rows are sorted inside files so time
    ranges skip row groups.
    """
    placed = bars.withColumn("year", F.year("ts"))
    part = F.floor((F.month("ts") - 1) / F.lit(months_per_task))
    (
        placed.repartition("symbol", "year", part)
        .sortWithinPartitions("symbol", "year", "ts")
        .write.partitionBy("symbol", "year")
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def read_lake(
    spark: SparkSession,
    path: str,
    symbols: list[str] | None = None,
    start: str | None = None,
    session: str | None = None,
) -> DataFrame:
    """Bars of a lake; symbol and year prune folders, session and time prune row groups."""
    bars = spark.read.parquet(path)
    if symbols:
        bars = bars.where(F.col("symbol").isin(symbols))
    if start:
        bars = bars.where((F.col("year") >= int(start[:4])) & (F.col("ts") >= F.lit(start).cast("timestamp")))
    if session:
        bars = bars.where(F.col("session") == session)
    return bars


def lake_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbols present; only partition folders are read."""
    return spark.read.parquet(path).select("symbol").distinct()


def read_daily_series(spark: SparkSession, path: str, missing: str = ".", by: str | None = None) -> DataFrame:
    """Date and close, with a marker for days without a value; ``by`` names the folders of several series."""
    return (
        spark.read.schema("date date, close double" + (f", {by} string" if by else ""))
        .option("header", True)
        .option("nullValue", missing)
        .csv(path)
        .where(F.col("close").isNotNull())
    )


def replace_series(series: DataFrame, path: str, min_rows: int = 100) -> None:
    """Overwrite a stored series; a suspiciously short one is an error, so old data never stay unnoticed."""
    rows = series.limit(min_rows).count()
    if rows < min_rows:
        raise ValueError(f"the new series has {rows} rows, fewer than {min_rows}; nothing was replaced")
    series.write.mode("overwrite").parquet(path)
