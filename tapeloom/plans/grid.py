"""Parameter grids as rows, and sweeps over them."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.columns import known
from tapeloom.operators import metrics as M
from tapeloom.operators import outcomes as O
from tapeloom.operators.asof import activate
from tapeloom.operators.indicators import band_stage
from tapeloom.operators.series import full_avg, rolling

# Setup timeframe -> execution timeframes.
TF_PAIRS = {
    "4h": ["1h", "30min", "15min", "5min", "1min"],
    "2h": ["30min", "15min", "5min", "1min"],
    "1h": ["30min", "15min", "5min", "1min"],
    "30min": ["15min", "5min", "1min"],
    "15min": ["5min", "1min"],
    "5min": ["1min"],
}


def options(**axes: Iterable) -> Column:
    """Array of structs: every combination of the axes, for exploding next to a row."""
    names = list(axes)
    rows = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, combo)]) for combo in itertools.product(*axes.values())
    ]
    return F.array(*rows)


def cross_with(df: DataFrame, combos: Column, name: str = "_o") -> DataFrame:
    """Each row times a fixed list of combinations, expanded inside the row's own task."""
    return df.withColumn(name, F.explode(combos)).select(*df.columns, f"{name}.*")


def mtf_grid(symbols: DataFrame, fees: Sequence[float]) -> DataFrame:
    """The multi-timeframe grid for every symbol: band-fade and line-cross families with both fees."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("setup_tf"), F.lit(e).alias("exec_tf")) for s, es in TF_PAIRS.items() for e in es]
    )
    based = cross_with(symbols, pairs)
    fade = cross_with(
        based, options(dev=[2.0, 2.5], strict=[True, False], target=["r1", "r2", "midband", "opposite"], fee=fees)
    ).withColumn("strategy", F.lit("fffd"))
    lines = cross_with(
        based, options(adx_filter=[True, False], sl=[0.005, 0.01], tp=[0.005, 0.01], fee=fees)
    ).withColumn("strategy", F.lit("didi"))
    return fade.unionByName(lines, allowMissingColumns=True)


def label(df: DataFrame) -> Column:
    """Short human label of a grid row."""
    pct = lambda c: F.concat(F.round(F.col(c) * 100, 1).cast("string"), F.lit("%"))
    arrow = F.concat(F.col("setup_tf"), F.lit("→"), F.col("exec_tf"))
    fade = F.concat_ws(
        " · ",
        F.concat(F.lit("FFFD "), arrow),
        F.when(F.col("strict"), "strict").otherwise("loose"),
        F.concat(F.lit("dev "), F.col("dev").cast("string")),
        F.col("target"),
    )
    lines = F.concat_ws(
        " · ",
        F.concat(F.lit("Didi "), arrow),
        F.when(F.col("adx_filter"), "ADX"),
        F.concat(F.lit("sl "), pct("sl")),
        F.concat(F.lit("tp "), pct("tp")),
    )
    return F.when(F.col("strategy") == "fffd", fade).otherwise(lines)


def plateau(stats: DataFrame, group: Sequence[str], windows: Sequence[int], min_trades: int = 30, top: int = 10) -> DataFrame:
    """Best rows whose neighbours one step away on the window grid are also profitable.

    A neighbour must keep fast below slow and have a known profit factor to be checked; at least half
    of the checked ones, and one, must exceed 1.
    """
    group = list(group)
    index = F.array(*[F.lit(w) for w in windows])
    placed = stats.withColumn("_fi", F.array_position(index, F.col("fast"))).withColumn(
        "_si", F.array_position(index, F.col("slow"))
    )
    moves = F.array(
        *[F.struct(F.lit(a).alias("df"), F.lit(b).alias("ds")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    )
    votes = (
        placed.where(F.col("profit_factor").isNotNull())
        .withColumn("_m", F.explode(moves))
        .select(
            *group,
            (F.col("_fi") + F.col("_m.df")).alias("_fi"),
            (F.col("_si") + F.col("_m.ds")).alias("_si"),
            (F.col("profit_factor") > 1).alias("_good"),
        )
        .groupBy(*group, "_fi", "_si")
        .agg(F.count(F.lit(1)).alias("checked"), F.count_if("_good").alias("good"))
    )
    viable = placed.where((F.col("n_trades") >= min_trades) & F.col("profit_factor").isNotNull())
    ok = viable.join(votes, [*group, "_fi", "_si"]).where(
        F.col("good") >= F.greatest(F.lit(1), F.floor(F.col("checked") / 2))
    )
    return ok.drop("_fi", "_si").orderBy(F.desc("profit_factor"), *group, "fast", "slow").limit(top)


def fade_events(setup: DataFrame, devs: Sequence[float], window: int = 20) -> DataFrame:
    """Band re-entry signals of every (dev, strict) in one pass: the band is computed once."""
    outside, before = {}, {}
    for i, dev in enumerate(devs):
        hi, lo = F.col("mid") + dev * F.col("_sd"), F.col("mid") - dev * F.col("_sd")
        outside |= {
            f"_a{i}": lambda w, x=hi: known(F.col("close") > x),
            f"_b{i}": lambda w, x=lo: known(F.col("close") < x),
        }
        for side, k in itertools.product("ab", (1, 2)):
            before[f"_{side}{i}_{k}"] = lambda w, c=f"_{side}{i}", k=k: F.coalesce(F.lag(c, k).over(w), F.lit(False))
    out = rolling(
        setup,
        window + 2,
        band_stage(window),
        outside,
        before | {"_pl": lambda w: F.lag("low").over(w), "_ph": lambda w: F.lag("high").over(w)},
    )
    rows = []
    for (i, dev), strict, (side, sign) in itertools.product(enumerate(devs), (True, False), (("b", 1), ("a", -1))):
        cond = F.col(f"_{side}{i}_1") & ~F.col(f"_{side}{i}")
        if strict:
            cond = cond & ~F.col(f"_{side}{i}_2")
        trigger, stop = ("high", F.least("_pl", "low")) if sign == 1 else ("low", F.greatest("_ph", "high"))
        rows.append(
            F.when(
                cond,
                F.struct(
                    F.lit(dev).alias("dev"),
                    F.lit(strict).alias("strict"),
                    F.lit(sign).alias("dir"),
                    F.col(trigger).alias("trigger"),
                    stop.alias("stop"),
                ),
            )
        )
    fired = out.withColumn("_e", F.explode(F.array_compact(F.array(*rows))))
    return fired.select("symbol", "ts", "bar_no", "_e.*")
