"""Indicators on numbered bars (``symbol, ts, bar_no, ...``); unknown values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import MARKET, div, known, local_day
from tapeloom.operators.series import (
    Step,
    chain,
    ema_alpha,
    ewm_step,
    full_agg,
    full_avg,
    lag,
    rolling,
)


def sma(bars: DataFrame, windows: list[int], value: str = "close") -> DataFrame:
    return rolling(bars, max(windows), {f"sma_{n}": full_avg(value, n) for n in windows})


def bollinger(bars: DataFrame, n: int = 20, dev: float = 2.0, sample: bool = False) -> DataFrame:
    """Band of ``dev`` standard deviations; population sigma unless ``sample``."""
    return rolling(bars, n, band_stage(n, sample)).withColumns(band_edges(dev))


def band_stage(n: int, sample: bool = False):
    std = F.stddev_samp if sample else F.stddev_pop
    return {"mid": full_avg("close", n), "_sd": full_agg(std, "close", n)}


def band_edges(dev: float) -> dict[str, Column]:
    return {"lower": F.col("mid") - dev * F.col("_sd"), "upper": F.col("mid") + dev * F.col("_sd")}


def band_edge_stage(dev: float):
    return {n: (lambda w, c=c: c) for n, c in band_edges(dev).items()}


def donchian(bars: DataFrame, n: int) -> DataFrame:
    """Extremes of the ``n`` bars before the current one."""
    return rolling(bars, n, donchian_stage(n))


def donchian_stage(n: int):
    return {
        "prior_high": full_agg(F.max, "high", n, end=-1),
        "prior_low": full_agg(F.min, "low", n, end=-1),
    }


def roc(bars: DataFrame, n: int) -> DataFrame:
    return rolling(bars, n, roc_stage(n))


def roc_stage(n: int):
    return {"roc": lambda w: div(F.col("close"), F.lag("close", n).over(w)) - 1}


def didi(bars: DataFrame, fast: int = 3, mid: int = 8, slow: int = 20) -> DataFrame:
    """Fast and slow averages relative to the middle one."""
    return rolling(bars, slow, *didi_stages(fast, mid, slow)).drop("_f", "_m", "_s")


def didi_stages(fast: int, mid: int, slow: int):
    return (
        {"_f": full_avg("close", fast), "_m": full_avg("close", mid), "_s": full_avg("close", slow)},
        {
            "curta": lambda w: div(F.col("_f"), F.col("_m")) - 1,
            "longa": lambda w: div(F.col("_s"), F.col("_m")) - 1,
        },
    )


def rsi_steps(n: int = 14, name: str = "rsi") -> list[Step]:
    """Wilder RSI; the smoothing starts with the second bar."""
    change = F.col("close") - F.col("_prev")
    smooth = {
        "_gain": (F.greatest(change, F.lit(0.0)), 1.0 / n),
        "_loss": (F.greatest(-change, F.lit(0.0)), 1.0 / n),
    }
    return [
        Step(1, {"_prev": lag("close")}),
        ewm_step(smooth, first=1),
        Step(0, {name: lambda w: div(F.col("_gain") * 100, F.col("_gain") + F.col("_loss"))}),
    ]


def rsi(bars: DataFrame, n: int = 14, name: str = "rsi") -> DataFrame:
    return chain(bars, *rsi_steps(n, name)).drop("_prev", "_gain", "_loss")


def macd_steps(fast: int = 12, slow: int = 26, signal: int = 9) -> list[Step]:
    close = F.col("close")
    return [
        ewm_step({"_fast": (close, ema_alpha(fast)), "_slow": (close, ema_alpha(slow))}),
        Step(0, {"macd_line": lambda w: F.col("_fast") - F.col("_slow")}),
        ewm_step({"macd_signal": (F.col("macd_line"), ema_alpha(signal))}),
    ]


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return chain(bars, *macd_steps(fast, slow, signal)).drop("_fast", "_slow")


def adx(bars: DataFrame, n: int = 8) -> DataFrame:
    """Wilder DMI/ADX. DX is unknown only before the first directional move of a symbol."""
    up, dn = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
    plus = F.when(known((up > dn) & (up > 0)), up).otherwise(0.0)
    minus = F.when(known((dn > up) & (dn > 0)), dn).otherwise(0.0)
    true_range = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))
    )
    smooth = chain(
        bars,
        Step(1, {"_ph": lag("high"), "_pl": lag("low"), "_pc": lag("close")}),
        ewm_step({"_p": (plus, 1.0 / n), "_m": (minus, 1.0 / n), "_atr": (true_range, 1.0 / n)}),
    )
    di = smooth.withColumn("plus_di", div(F.col("_p") * 100, F.col("_atr"))).withColumn(
        "minus_di", div(F.col("_m") * 100, F.col("_atr"))
    )
    dx = di.withColumn(
        "_dx",
        div(F.abs(F.col("plus_di") - F.col("minus_di")) * 100, F.col("plus_di") + F.col("minus_di")),
    )
    first = dx.groupBy("symbol").agg(F.min(F.when(F.col("_dx").isNotNull(), F.col("bar_no"))).alias("_first"))
    out = chain(dx.join(first, "symbol"), ewm_step({"adx": (F.col("_dx"), 1.0 / n)}, first=F.col("_first")))
    return out.drop("_ph", "_pl", "_pc", "_p", "_m", "_atr", "_dx", "_first")


def session_vwap(bars: DataFrame, band_k: float = 1.5, tz: str = MARKET) -> DataFrame:
    """Running VWAP and deviation band since the session's first bar; a session bounds each group."""
    day = Window.partitionBy("symbol", "_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = (
        bars.withColumn("_day", local_day(F.col("ts"), tz))
        .withColumn(
            "vwap", div(F.sum(F.col("close") * F.col("volume")).over(day), F.sum("volume").over(day))
        )
        .withColumn("session_bars", F.count(F.lit(1)).over(day))
        .withColumn("_dev", F.col("close") - F.col("vwap"))
        .withColumn("_s1", F.sum("_dev").over(day))
        .withColumn("_s2", F.sum(F.col("_dev") * F.col("_dev")).over(day))
    )
    n = F.col("session_bars")
    var = F.greatest(F.col("_s2") / n - F.pow(F.col("_s1") / n, F.lit(2.0)), F.lit(0.0))
    band = F.when(F.col("_dev").isNotNull(), band_k * F.sqrt(var))
    return out.withColumn("vwap_lower", F.col("vwap") - band).withColumn("vwap_upper", F.col("vwap") + band).drop(
        "_dev", "_s1", "_s2", "_day"
    )
