"""Entry families: each turns bars into sparse event rows.

Setup-bar families return events ``(symbol, ts, bar_no, dir, trigger, stop)``, visible at the setup
bar's close. Execution-bar families return entries ``(symbol, entry_ts, entry_no, dir, price,
stop_pct)``. ``generate`` dispatches on the family name and always returns entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import MARKET, div, known, local_day
from tapeloom.operators import indicators as I
from tapeloom.operators.asof import activate, span_join
from tapeloom.operators.series import Step, chain, ema_alpha, ewm_step, full_avg, lag, rolling

SETUP: dict[str, Callable[..., DataFrame]] = {}
EXEC: dict[str, Callable[..., DataFrame]] = {}
NOISE = 1e-12
EVENT = ["symbol", "ts", "bar_no", "dir", "trigger", "stop"]
ENTRY = ["symbol", "entry_ts", "entry_no", "dir", "price", "stop_pct"]


def signal(kind: str, table: dict = SETUP):
    def add(fn):
        table[kind] = fn
        return fn

    return add


def cross_up(x: Column, prev: Column) -> Column:
    return known((x > 0) & (prev <= 0))


def cross_down(x: Column, prev: Column) -> Column:
    return known((x < 0) & (prev >= 0))


def two_sided(
    df: DataFrame,
    long_cond: Column,
    short_cond: Column,
    long_levels: tuple[Column, Column] | None = None,
    short_levels: tuple[Column, Column] | None = None,
) -> DataFrame:
    """One row per side that fires; levels are (trigger, stop)."""
    none = (F.lit(None).cast("double"), F.lit(None).cast("double"))

    def row(side: int, levels) -> Column:
        trigger, stop = levels or none
        return F.struct(
            F.lit(side).alias("dir"), trigger.cast("double").alias("trigger"), stop.cast("double").alias("stop")
        )

    fired = F.array_compact(
        F.array(
            F.when(known(long_cond), row(1, long_levels)), F.when(known(short_cond), row(-1, short_levels))
        )
    )
    return df.withColumn("_e", F.explode(fired)).select(
        "symbol", "ts", "bar_no", "_e.dir", "_e.trigger", "_e.stop"
    )


def crosses(bars: DataFrame, diff: Column, *steps: Step) -> DataFrame:
    """Events where ``diff`` of the stepped columns changes sign; rounding noise counts as zero."""
    quiet = F.when(F.abs(diff) > F.abs(F.col("close")) * NOISE, diff).when(diff.isNotNull(), 0.0)
    out = chain(bars, *steps, Step(0, {"_d": lambda w: quiet}), Step(1, {"_dp": lag("_d")}))
    return two_sided(out, cross_up(F.col("_d"), F.col("_dp")), cross_down(F.col("_d"), F.col("_dp")))


@signal("ma_cross")
def ma_cross(bars: DataFrame, fast: int = 9, slow: int = 21, ma_type: str = "sma") -> DataFrame:
    if ma_type == "ema":
        close = F.col("close")
        lines = ewm_step({"_fast": (close, ema_alpha(fast)), "_slow": (close, ema_alpha(slow))})
    else:
        lines = Step(slow, {"_fast": full_avg("close", fast), "_slow": full_avg("close", slow)})
    return crosses(bars, F.col("_fast") - F.col("_slow"), lines)


def _edge(above: Column, below: Column):
    return (
        {"_a": lambda w: known(above), "_b": lambda w: known(below)},
        {
            "_ap": lambda w: F.coalesce(F.lag("_a").over(w), F.lit(False)),
            "_bp": lambda w: F.coalesce(F.lag("_b").over(w), F.lit(False)),
        },
    )


@signal("donchian")
def donchian(bars: DataFrame, window: int = 20) -> DataFrame:
    edge = _edge(F.col("close") > F.col("prior_high"), F.col("close") < F.col("prior_low"))
    out = rolling(bars, window + 1, I.donchian_stage(window), *edge)
    return two_sided(out, F.col("_a") & ~F.col("_ap"), F.col("_b") & ~F.col("_bp"))


@signal("boll")
def boll(bars: DataFrame, window: int = 20, dev: float = 2.0, mode: str = "trend") -> DataFrame:
    """Band events with sample sigma: break out of the band, or return inside it."""
    edge = _edge(F.col("close") > F.col("upper"), F.col("close") < F.col("lower"))
    out = rolling(bars, window + 1, I.band_stage(window, sample=True), I.band_edge_stage(dev), *edge)
    if mode == "trend":
        return two_sided(out, F.col("_a") & ~F.col("_ap"), F.col("_b") & ~F.col("_bp"))
    return two_sided(out, ~F.col("_b") & F.col("_bp"), ~F.col("_a") & F.col("_ap"))


@signal("macd")
def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return crosses(bars, F.col("macd_line") - F.col("macd_signal"), *I.macd_steps(fast, slow, signal))


@signal("mom")
def momentum(bars: DataFrame, window: int = 10, thr: float = 0.01) -> DataFrame:
    out = rolling(bars, window + 1, I.roc_stage(window), {"_p": lag("roc")})
    x, p = F.col("roc"), F.col("_p")
    return two_sided(out, (x > thr) & (p <= thr), (x < -thr) & (p >= -thr))


@signal("rsi_cross")
def rsi_cross(bars: DataFrame, window: int = 14, lo: float = 30, hi: float = 70) -> DataFrame:
    out = chain(bars, *I.rsi_steps(window), Step(1, {"_p": lag("rsi")}))
    x, p = F.col("rsi"), F.col("_p")
    return two_sided(out, (x > lo) & (p <= lo), (x < hi) & (p >= hi))


def agulhada(bars: DataFrame, tol_bars: int = 1, fast: int = 3, mid: int = 8, slow: int = 20) -> DataFrame:
    """Both lines crossed the baseline in opposite directions within ``tol_bars``; first bar only."""
    w_ = tol_bars + 1

    def within(name: str):
        return lambda w: F.max(F.col(name).cast("int")).over(w.rowsBetween(-(w_ - 1), 0)) == 1

    out = rolling(
        bars,
        slow + w_ + 2,
        *I.didi_stages(fast, mid, slow),
        {"_cp": lag("curta"), "_lp": lag("longa")},
        {
            "_cu": lambda w: cross_up(F.col("curta"), F.col("_cp")),
            "_cd": lambda w: cross_down(F.col("curta"), F.col("_cp")),
            "_lu": lambda w: cross_up(F.col("longa"), F.col("_lp")),
            "_ld": lambda w: cross_down(F.col("longa"), F.col("_lp")),
        },
        {"_cu": within("_cu"), "_cd": within("_cd"), "_lu": within("_lu"), "_ld": within("_ld")},
        {
            "_alta": lambda w: known(F.col("_cu") & F.col("_ld") & (F.col("curta") > 0) & (F.col("longa") < 0)),
            "_baixa": lambda w: known(F.col("_cd") & F.col("_lu") & (F.col("curta") < 0) & (F.col("longa") > 0)),
        },
        {
            "_ap": lambda w: F.coalesce(F.lag("_alta").over(w), F.lit(False)),
            "_bp": lambda w: F.coalesce(F.lag("_baixa").over(w), F.lit(False)),
        },
    )
    nothing = F.lit(None).cast("double")
    return two_sided(
        out,
        F.col("_alta") & ~F.col("_ap"),
        F.col("_baixa") & ~F.col("_bp"),
        (F.col("high"), nothing),
        (F.col("low"), nothing),
    )


def adx_confirm(bars: DataFrame, n: int = 8, threshold: float = 32.0) -> DataFrame:
    """ADX above the threshold and rising, with the directional lines agreeing."""
    out = rolling(I.adx(bars, n), 1, {"_p": lag("adx")})
    base = (F.col("adx") > threshold) & (F.col("adx") - F.col("_p") > NOISE * 100)
    return out.withColumn("long_ok", known(base & (F.col("plus_di") > F.col("minus_di")))).withColumn(
        "short_ok", known(base & (F.col("minus_di") > F.col("plus_di")))
    )


@signal("didi")
def didi(bars: DataFrame, tol_bars: int = 1, adx_filter: bool = False, adx_threshold: float = 32.0) -> DataFrame:
    events = agulhada(bars, tol_bars)
    if not adx_filter:
        return events
    ok = adx_confirm(bars, threshold=adx_threshold).select("symbol", "ts", "long_ok", "short_ok")
    return (
        events.join(ok, ["symbol", "ts"])
        .where(F.when(F.col("dir") == 1, F.col("long_ok")).otherwise(F.col("short_ok")))
        .select(*EVENT)
    )


@signal("fffd")
def fffd(bars: DataFrame, dev: float = 2.0, strict: bool = False, window: int = 20, same_session: bool = False,
         tz: str = MARKET) -> DataFrame:
    """Closed outside the band, then closed inside: fade. ``strict`` wants exactly one outside close."""
    edge = _edge(F.col("close") > F.col("upper"), F.col("close") < F.col("lower"))
    day = local_day(F.col("ts"), tz)
    out = rolling(
        bars,
        window + 2,
        I.band_stage(window),
        I.band_edge_stage(dev),
        *edge,
        {
            "_ap2": lambda w: F.coalesce(F.lag("_a", 2).over(w), F.lit(False)),
            "_bp2": lambda w: F.coalesce(F.lag("_b", 2).over(w), F.lit(False)),
            "_pl": lag("low"),
            "_ph": lag("high"),
            "_pday": lambda w: F.lag(day).over(w),
        },
    )
    long_c = F.col("_bp") & ~F.col("_b")
    short_c = F.col("_ap") & ~F.col("_a")
    if strict:
        long_c, short_c = long_c & ~F.col("_bp2"), short_c & ~F.col("_ap2")
    if same_session:
        out = out.where(known(F.col("_pday") == day))
    return two_sided(
        out,
        long_c,
        short_c,
        (F.col("high"), F.least("_pl", "low")),
        (F.col("low"), F.greatest("_ph", "high")),
    )


def midband_exits(bars: DataFrame, window: int = 20) -> DataFrame:
    """Closes crossing the middle of the band: dir 1 ends longs, -1 ends shorts."""
    return crosses(bars, F.col("close") - F.col("mid"), Step(window, {"mid": full_avg("close", window)}))


def delayed(events: DataFrame, bars: DataFrame, delay: int = 1) -> DataFrame:
    """Act at the open ``delay`` bars after the signal bar."""
    target = bars.select(
        "symbol", (F.col("bar_no") - delay).alias("bar_no"), F.col("ts").alias("entry_ts"), F.col("open").alias("price")
    )
    return events.join(target, ["symbol", "bar_no"]).select("symbol", "ts", "dir", "entry_ts", "price")


# ------------------------------------------------------------ execution-bar families


def entry_rows(df: DataFrame, price: Column, stop_pct: Column) -> DataFrame:
    return df.select(
        "symbol",
        F.col("ts").alias("entry_ts"),
        F.col("bar_no").alias("entry_no"),
        "dir",
        price.cast("double").alias("price"),
        stop_pct.cast("double").alias("stop_pct"),
    )


@signal("orb", EXEC)
def orb(setup: DataFrame, bars: DataFrame, setup_tf: str, range_min: int = 30, tz: str = MARKET) -> DataFrame:
    """First break of the opening range, one per session; a bar breaking both sides counts as long."""
    day = bars.withColumn("_day", local_day(F.col("ts"), tz))
    start = day.groupBy("symbol", "_day").agg(F.min("ts").alias("_start"))
    placed = day.join(start, ["symbol", "_day"]).withColumn(
        "_in", F.col("ts") < F.timestamp_micros(F.unix_micros("_start") + F.lit(range_min * 60_000_000))
    )
    rng = placed.where("_in").groupBy("symbol", "_day").agg(F.max("high").alias("_hi"), F.min("low").alias("_lo"))
    after = placed.where(~F.col("_in")).join(rng, ["symbol", "_day"])
    up, dn = F.col("high") > F.col("_hi"), F.col("low") < F.col("_lo")
    hit = F.struct("ts", "bar_no", "open", F.when(up, 1).otherwise(-1).alias("dir"), "_hi", "_lo")
    first = (
        after.where(up | dn).groupBy("symbol", "_day").agg(F.min_by(hit, "bar_no").alias("h")).select("symbol", "h.*")
    )
    price = F.when(F.col("dir") == 1, F.greatest("open", "_hi")).otherwise(F.least("open", "_lo"))
    return entry_rows(first, price, F.lit(None))


@signal("vwap", EXEC)
def vwap(setup: DataFrame, bars: DataFrame, setup_tf: str, mode: str = "revert", band_k: float = 1.5,
         warmup_bars: int = 15, tz: str = MARKET) -> DataFrame:
    """Session VWAP: re-enter the band, or cross the VWAP; both bars in one session."""
    v = I.session_vwap(bars, band_k, tz).withColumn("_day", local_day(F.col("ts"), tz))
    w = Window.partitionBy("symbol", "_day").orderBy("ts")
    low, high = ("vwap_lower", "vwap_upper") if mode == "revert" else ("vwap", "vwap")
    v = v.withColumns({"_dl": F.col("close") - F.col(low), "_dh": F.col("close") - F.col(high)})
    v = v.withColumns({"_dlp": F.lag("_dl").over(w), "_dhp": F.lag("_dh").over(w)})
    warm = F.col("session_bars") >= warmup_bars
    events = two_sided(
        v, warm & cross_up(F.col("_dl"), F.col("_dlp")), warm & cross_down(F.col("_dh"), F.col("_dhp"))
    )
    return entry_rows(events, F.lit(None), F.lit(None))


def _armed(events: DataFrame, bars: DataFrame, setup_tf: str) -> DataFrame:
    """Events with the position of their first execution bar."""
    return activate(events, bars, setup_tf, {"bar_no": "act"})


@signal("fffd_ff", EXEC)
def fffd_ff(setup: DataFrame, bars: DataFrame, setup_tf: str, dev: float = 2.0, wait_bars: int = 3,
            vol_mult: float = 0.0, tol: float = 0.0, window: int = 20, tz: str = MARKET) -> DataFrame:
    """Outside close, then ``wait_bars`` execution bars that respect its extreme: enter at the last close."""
    out = rolling(setup, window, I.band_stage(window), I.band_edge_stage(dev), {"_vol": full_avg("volume", window)})
    heavy = known(F.col("volume") >= vol_mult * F.col("_vol")) if vol_mult > 0 else F.lit(True)
    nothing = F.lit(None).cast("double")
    events = two_sided(
        out,
        (F.col("close") < F.col("lower")) & heavy,
        (F.col("close") > F.col("upper")) & heavy,
        (F.col("low") * (1 - tol), nothing),
        (F.col("high") * (1 + tol), nothing),
    )
    ahead = wait_bars - 1
    look = rolling(
        bars.withColumn("_day", local_day(F.col("ts"), tz)),
        0,
        {
            "_hi": lambda w: F.max("high").over(w.rowsBetween(0, ahead)),
            "_lo": lambda w: F.min("low").over(w.rowsBetween(0, ahead)),
            "_x": lambda w: F.lead(F.struct("ts", "bar_no", "close", "_day"), ahead).over(w),
        },
        ahead=ahead,
    ).select("symbol", F.col("bar_no").alias("act"), "_hi", "_lo", "_x", "_day")
    hit = _armed(events, bars, setup_tf).join(look, ["symbol", "act"]).where(known(F.col("_x._day") == F.col("_day")))
    lim, close = F.col("trigger"), F.col("_x.close")
    ok = F.when(F.col("dir") == 1, F.col("_lo") >= lim).otherwise(F.col("_hi") <= lim)
    dist = div(F.when(F.col("dir") == 1, close - lim).otherwise(lim - close), close)
    return (
        hit.where(ok)
        .select(
            "symbol",
            F.col("_x.ts").alias("entry_ts"),
            F.col("_x.bar_no").alias("entry_no"),
            "dir",
            close.alias("price"),
            F.greatest(dist, F.lit(0.001)).alias("stop_pct"),
            F.col("ts").alias("_sig"),
        )
        .groupBy("symbol", "entry_ts", "entry_no", "dir", "price")
        .agg(F.max_by("stop_pct", "_sig").alias("stop_pct"))
    )


@signal("wick_bb", EXEC)
def wick_bb(setup: DataFrame, bars: DataFrame, setup_tf: str, dev: float = 2.0, wick_k: float = 1.5,
            confirm_bars: int = 6, window: int = 20, trend: int = 200, tz: str = MARKET) -> DataFrame:
    """Two rejection candles at the band, then the first execution close beyond its long average."""
    body = F.greatest(F.abs(F.col("close") - F.col("open")), F.col("close") * 1e-4)
    lo_wick = F.least("open", "close") - F.col("low")
    hi_wick = F.col("high") - F.greatest("open", "close")
    pins = _edge(
        (F.col("high") >= F.col("upper")) & (hi_wick >= wick_k * body),
        (F.col("low") <= F.col("lower")) & (lo_wick >= wick_k * body),
    )
    out = rolling(setup, window + 1, I.band_stage(window), I.band_edge_stage(dev), *pins)
    events = two_sided(out, F.col("_b") & F.col("_bp"), F.col("_a") & F.col("_ap"))
    armed = _armed(events, bars, setup_tf)
    trended = rolling(bars, trend, {"_ma": full_avg("close", trend)}).select(
        "symbol",
        "bar_no",
        F.struct(F.col("ts").alias("entry_ts"), "close", "_ma", local_day(F.col("ts"), tz).alias("_day")).alias("b"),
    )
    scan = span_join(
        armed.drop("bar_no"), trended, ["symbol"], F.col("act"), F.col("act") + (confirm_bars - 1), "bar_no", 256
    )
    beyond = F.when(F.col("dir") == 1, F.col("b.close") > F.col("b._ma")).otherwise(F.col("b.close") < F.col("b._ma"))
    per = scan.groupBy("symbol", "ts", "dir", "act").agg(
        F.max_by("b._day", F.when(F.col("bar_no") == F.col("act"), F.lit(1))).alias("_day"),
        F.min(F.when(F.col("b._ma").isNull(), F.col("bar_no"))).alias("_stop_no"),
        F.min_by(F.struct("bar_no", "b"), F.when(known(beyond), F.col("bar_no"))).alias("h"),
    )
    alive = (F.col("h.b._day") == F.col("_day")) & (
        F.col("_stop_no").isNull() | (F.col("_stop_no") > F.col("h.bar_no"))
    )
    hit = per.where(known(alive))
    close, ma = F.col("h.b.close"), F.col("h.b._ma")
    rows = hit.select(
        "symbol",
        F.col("h.b.entry_ts").alias("entry_ts"),
        F.col("h.bar_no").alias("entry_no"),
        "dir",
        close.alias("price"),
        F.greatest(div(F.abs(close - ma), close), F.lit(0.001)).alias("stop_pct"),
    )
    return rows.distinct()


def generate(kind: str, setup: DataFrame, bars: DataFrame, setup_tf: str, params: dict) -> DataFrame:
    """Entries of any family on the execution bars."""
    from tapeloom.operators.outcomes import breakout_entries

    if kind in EXEC:
        return EXEC[kind](setup, bars, setup_tf, **params).select(*ENTRY)
    events = SETUP[kind](setup, **params)
    if kind in ("didi", "fffd"):
        return breakout_entries(events, bars, setup_tf).select(*ENTRY)
    hit = activate(events, bars, setup_tf, {"bar_no": "entry_no", "ts": "entry_ts"})
    return (
        hit.select("symbol", "entry_ts", "entry_no", "dir")
        .distinct()
        .withColumns({"price": F.lit(None).cast("double"), "stop_pct": F.lit(None).cast("double")})
    )
