"""Entry gates on execution bars: each adds ``long_ok`` and ``short_ok``; unknown means no."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import MARKET, asset_class, div, known, local, local_day, local_minute, tf_seconds
from tapeloom.operators import indicators as I
from tapeloom.operators.asof import align_setup, align_setups, asof
from tapeloom.operators.series import Step, chain, ema_alpha, ewm_step, full_avg

GATES: dict[str, Callable[..., DataFrame]] = {}

# Central-bank decision days (second meeting day).
FOMC_DAYS = [
    "2025-01-29",
    "2025-03-19",
    "2025-05-07",
    "2025-06-18",
    "2025-07-30",
    "2025-09-17",
    "2025-10-29",
    "2025-12-10",
    "2026-01-28",
    "2026-03-18",
    "2026-04-29",
    "2026-06-17",
    "2026-07-29",
    "2026-09-16",
    "2026-10-28",
    "2026-12-09",
]
# The levels whose distance and slope are tracked (kind, timeframe, window).
LEVELS = [("sma", "1d", 200), ("sma", "1d", 50), ("ema", "4h", 21)]
FEATURE_TFS = ["1d", "4h", "2h", "1h", "30min", "15min"]


def gate(name: str):
    def add(fn):
        GATES[name] = fn
        return fn

    return add


def _ok(df: DataFrame, long_ok: Column, short_ok: Column | None = None) -> DataFrame:
    return df.withColumn("long_ok", known(long_ok)).withColumn(
        "short_ok", known(long_ok if short_ok is None else short_ok)
    )


def _days(bars: DataFrame, tz: str, *aggs: Column) -> tuple[DataFrame, DataFrame, object]:
    """Bars with their day, one row per (symbol, day), and a window along the days of a symbol."""
    tagged = bars.withColumn("_day", local_day(F.col("ts"), tz))
    return tagged, tagged.groupBy("symbol", "_day").agg(*aggs), Window.partitionBy("symbol").orderBy("_day")


@gate("gap")
def gap(bars: DataFrame, frames: dict, min_gap_pct: float = 0.5, mode: str = "any", tz: str = MARKET) -> DataFrame:
    """Days that open away from the previous close; ``aligned`` splits the sides by the gap's sign."""
    tagged, days, w = _days(
        bars, tz, F.min_by("open", "ts").alias("_open"), F.max_by("close", "ts").alias("_close")
    )
    gaps = days.select("symbol", "_day", (div(F.col("_open"), F.lag("_close").over(w)) - 1).alias("gap"))
    out = tagged.join(gaps, ["symbol", "_day"]).drop("_day")
    big = F.abs(F.col("gap")) >= min_gap_pct / 100
    if mode == "aligned":
        return _ok(out, big & (F.col("gap") > 0), big & (F.col("gap") < 0))
    return _ok(out, big)


@gate("compression")
def compression(bars: DataFrame, frames: dict, q: float = 0.8, days: int = 20, tz: str = MARKET) -> DataFrame:
    """The day after a day whose range was small against its ``days``-day mean."""
    tagged, per_day, w = _days(bars, tz, (F.max("high") - F.min("low")).alias("_rng"))
    span = w.rowsBetween(-(days - 1), 0)
    mean = F.when(F.count("_rng").over(span) == days, F.avg("_rng").over(span))
    flags = per_day.withColumn("_tight", F.col("_rng") <= q * mean).select(
        "symbol", "_day", F.lag("_tight").over(w).alias("_tight")
    )
    out = tagged.join(flags, ["symbol", "_day"])
    return _ok(out, F.col("_tight")).drop("_day", "_tight")


def moving_step(kind: str, n: int, name: str) -> Step:
    if kind == "ema":
        return ewm_step({name: (F.col("close"), ema_alpha(n))})
    return Step(n, {name: full_avg("close", n)})


@gate("trend")
def trend(bars: DataFrame, frames: dict, tf: str = "1d", ma: int = 20, kind: str = "sma") -> DataFrame:
    """Last completed bar of ``tf`` above its average; not-above includes an average still unknown."""
    frame = chain(frames[tf], moving_step(kind, ma, "_ma")).withColumn("_above", known(F.col("close") > F.col("_ma")))
    out = align_setup(bars, frame, tf, {"_above": "_above"}, width=tf_seconds(tf) * 24)
    return _ok(out, F.col("_above"), ~F.col("_above")).drop("_above")


@gate("trend_all")
def trend_all(bars: DataFrame, frames: dict, tf: str = "1d", smas=(20, 50, 200), emas=(9, 21)) -> DataFrame:
    """Above (or below) every average of the list on the last completed bar."""
    frame = chain(
        frames[tf],
        Step(max(smas), {f"_s{n}": full_avg("close", n) for n in smas}),
        ewm_step({f"_e{n}": (F.col("close"), ema_alpha(n)) for n in emas}),
    )
    levels = [f"_s{n}" for n in smas] + [f"_e{n}" for n in emas]
    above, below = F.lit(True), F.lit(True)
    for c in levels:
        above = above & known(F.col("close") > F.col(c))
        below = below & known(F.col("close") < F.col(c))
    frame = frame.withColumn("_above", above).withColumn("_below", below)
    out = align_setup(bars, frame, tf, {"_above": "_above", "_below": "_below"}, width=tf_seconds(tf) * 24)
    return _ok(out, F.col("_above"), F.col("_below")).drop("_above", "_below")


@gate("session")
def session(bars: DataFrame, frames: dict, window: str = "open60", crypto: bool | None = None, tz: str = MARKET) -> DataFrame:
    """Part of the session: its opening, its close, or everything but the middle.

    Coins have sessions of a UTC day, stocks those of the exchange; ``crypto`` overrides the class of the rows.
    """
    coin = asset_class(F.col("symbol").cast("string")) == "crypto" if crypto is None else F.lit(crypto)

    def of(around_the_clock: int, exchange: int) -> Column:
        return F.when(coin, around_the_clock).otherwise(exchange)

    minute = F.when(coin, local_minute(F.col("ts"), "UTC")).otherwise(local_minute(F.col("ts"), tz) - 570)
    length, opening, closing, mid = of(1440, 390), of(240, 60), of(240, 90), of(360, 90)
    if window == "open60":
        return _ok(bars, minute < opening)
    if window == "close90":
        return _ok(bars, minute >= length - closing)
    return _ok(bars, (minute < mid) | (minute >= length - mid))


@gate("vix")
def vix(bars: DataFrame, frames: dict, op: str = "lt", x: float = 20.0, tz: str = MARKET) -> DataFrame:
    """Daily index level strictly before the bar's local day; ``frames['vix']`` is (date, close)."""
    day = bars.withColumn("_all", F.lit(0)).withColumn("_day", local_day(F.col("ts"), tz))
    dates = day.select("_all", F.col("_day").cast("timestamp").alias("_dts"), "_day").distinct()
    values = frames["vix"].select(
        F.lit(0).alias("_all"), F.col("date").cast("timestamp").alias("ts"), F.col("close").alias("_vix")
    )
    hit = asof(
        dates, values, ["_all"], "_dts", "ts", {"_vix": "_vix"}, allow_equal=False, width=86400 * 365
    ).select("_day", "_vix")
    out = day.join(hit, "_day", "left")
    level = F.col("_vix")
    return _ok(out, level < x if op == "lt" else level > x).drop("_all", "_day", "_vix")


def is_event_day(day: Column) -> Column:
    """Decision days, plus the first Friday of the month."""
    fomc = F.date_format(day, "yyyy-MM-dd").isin(FOMC_DAYS)
    return fomc | ((F.weekday(day) == 4) & (F.dayofmonth(day) <= 7))


@gate("event")
def event(bars: DataFrame, frames: dict, mode: str = "avoid", tz: str = MARKET) -> DataFrame:
    hit = is_event_day(local_day(F.col("ts"), tz))
    return _ok(bars, ~hit if mode == "avoid" else hit)


def level_matrix(bars: DataFrame, frames: dict, levels=LEVELS, day_tf: str = "1d") -> DataFrame:
    """Percent distance from close to each higher-timeframe level, its slope sign, prior day's extremes."""
    by_tf: dict[str, list] = {}
    for kind, tf, n in levels:
        by_tf.setdefault(tf, []).append((kind, n))
    by_tf.setdefault(day_tf, [])
    sides, names = [], []
    for tf, specs in by_tf.items():
        frame, cols, steps = frames[tf], {}, []
        for kind, n in specs:
            name = f"{kind}{n}_{tf}"
            slope = {f"_slope_{name}": lambda w, c=name: F.signum(F.col(c) - F.lag(c).over(w))}
            steps += [moving_step(kind, n, name), Step(1, slope)]
            cols |= {name: f"_{name}", f"_slope_{name}": f"slope_{name}"}
            names.append(name)
        if tf == day_tf:
            cols |= {"high": "_pdh", "low": "_pdl"}
        sides.append((chain(frame, *steps) if steps else frame, tf, cols))
    out = align_setups(bars, sides, width=tf_seconds(day_tf) * 7)
    dist = {f"dist_{n}": div((F.col("close") - F.col(f"_{n}")) * 100, F.col(f"_{n}")) for n in names}
    dist |= {f"dist_{n}": div((F.col("close") - F.col(f"_{n}")) * 100, F.col(f"_{n}")) for n in ("pdh", "pdl")}
    return out.withColumns(dist).drop(*[f"_{n}" for n in names], "_pdh", "_pdl")


@gate("level")
def level(bars: DataFrame, frames: dict, block_long=(), block_short=(), levels=LEVELS) -> DataFrame:
    """Block entries while a distance column lies inside a band (col, lo, hi)."""
    out = level_matrix(bars, frames, levels)

    def clear(bands) -> Column:
        ok = F.lit(True)
        for col, lo, hi in bands:
            ok = ok & ~known(F.col(col).between(lo, hi))
        return ok

    return _ok(out, clear(block_long), clear(block_short))


def rsi_matrix(bars: DataFrame, frames: dict, tfs=FEATURE_TFS, n: int = 14) -> DataFrame:
    """RSI of every timeframe on the execution bars, in one alignment pass."""
    sides = [(I.rsi(frames[tf], n), tf, {"rsi": f"rsi_{tf}"}) for tf in tfs]
    return align_setups(bars, sides, width=tf_seconds("1d") * 2)


@gate("rsi")
def rsi(bars: DataFrame, frames: dict, tf: str = "1d", window: int = 14, long=(0, 100), short=(0, 100),
        mode: str = "inside") -> DataFrame:
    out = align_setup(bars, I.rsi(frames[tf], window), tf, {"rsi": "_rsi"}, width=tf_seconds(tf) * 24)

    def band(lo, hi) -> Column:
        if mode == "outside":
            return (F.col("_rsi") < lo) | (F.col("_rsi") > hi)
        return (F.col("_rsi") >= lo) & (F.col("_rsi") <= hi)

    return _ok(out, band(*long), band(*short)).drop("_rsi")


def apply_gate(entries: DataFrame, bars: DataFrame, frames: dict, spec: dict) -> DataFrame:
    """Keep the entries whose side the gate allows on their bar."""
    params = {k: v for k, v in spec.items() if k != "ind"}
    ok = GATES[spec["ind"]](bars, frames, **params).select(
        "symbol", F.col("bar_no").alias("entry_no"), "long_ok", "short_ok"
    )
    side_ok = F.when(F.col("dir") == 1, F.col("long_ok")).otherwise(F.col("short_ok"))
    return entries.join(ok, ["symbol", "entry_no"]).where(side_ok).drop("long_ok", "short_ok")


def block_session_end(entries: DataFrame, masked_bars: DataFrame) -> DataFrame:
    """No new entries late in the session or on its last bar."""
    ok = masked_bars.where(~F.col("late") & ~F.col("eod")).select("symbol", F.col("bar_no").alias("entry_no"))
    return entries.join(ok, ["symbol", "entry_no"], "left_semi")
