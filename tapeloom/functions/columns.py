"""Small column expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
#: stands for the zone of each row's own market (see :func:`market_zone`)
MARKET = "market"
US_PER_SECOND = 1_000_000

# The timeframe vocabulary, in seconds.
TIMEFRAMES = {
    "1min": 60,
    "5min": 300,
    "15min": 900,
    "30min": 1800,
    "1h": 3600,
    "2h": 7200,
    "4h": 14400,
    "1d": 86400,
}


def tf_seconds(tf: str) -> int:
    return TIMEFRAMES[tf]


def add_tf(ts: Column, tf: str | Column, bars: int = 1) -> Column:
    """``bars`` intervals later; a column holds the name of each row's timeframe."""
    width = F.lit(bars * tf_seconds(tf) * US_PER_SECOND) if isinstance(tf, str) else width_of(tf) * (bars * US_PER_SECOND)
    return F.timestamp_micros(F.unix_micros(ts) + width)


def width_of(tf: Column) -> Column:
    """Seconds of a timeframe column."""
    return F.coalesce(*[F.when(tf == name, F.lit(seconds)) for name, seconds in TIMEFRAMES.items()]).cast("long")


def floor_ts(ts: Column, seconds: int) -> Column:
    width = seconds * US_PER_SECOND
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(width)))


def known(cond: Column) -> Column:
    """Unknown comparisons count as false."""
    return F.coalesce(cond, F.lit(False))


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def r(col: Column, digits: int = 6) -> Column:
    """Round at the report edge. The nudge sends exact halves up whatever their last bit; adding zero
    removes negative zero."""
    return F.round(col + F.lit(1e-11), digits) + F.lit(0.0)


def market_zone(symbol: Column | None = None) -> Column:
    """Coins keep UTC days, stocks those of New York."""
    symbol = F.col("symbol") if symbol is None else symbol
    return F.when(asset_class(symbol.cast("string")) == "crypto", F.lit("UTC")).otherwise(F.lit(NEW_YORK))


def zone(tz: str | Column) -> str | Column:
    return market_zone() if isinstance(tz, str) and tz == MARKET else tz


def local(ts: Column, tz: str | Column = NEW_YORK) -> Column:
    return F.from_utc_timestamp(ts, zone(tz))


def local_day(ts: Column, tz: str | Column = NEW_YORK) -> Column:
    return F.to_date(local(ts, tz))


def local_minute(ts: Column, tz: str | Column = NEW_YORK) -> Column:
    lt = local(ts, tz)
    return F.hour(lt) * 60 + F.minute(lt)


def ntz(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def asset_class(symbol: Column) -> Column:
    """Symbols quoted in a stablecoin trade around the clock; the rest are stocks."""
    return F.when(symbol.rlike("USD[TC]$"), F.lit("crypto")).otherwise(F.lit("stock"))


def finite(col: Column) -> Column:
    """NaN and infinities become NULL."""
    bad = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(~known(bad), col)


def magnitude_bucket(col: Column, per_octave: int = 16) -> Column:
    """Order-preserving integer bucket of a double, fine near zero and coarse far away.

    It depends on the value only, so two evaluations of one plan always agree.
    """
    mag = F.floor(F.log2(F.lit(1.0) + F.abs(col) * 1024.0) * per_octave)
    return F.when(col < 0, -mag - 1).otherwise(mag)


def snake(text: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", text.lower()).strip("_")
