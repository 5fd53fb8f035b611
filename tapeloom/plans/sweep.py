"""Whole parameter sweeps: events once per distinct signal, exits looked up on a first-touch ladder."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.columns import div
from tapeloom.operators import metrics as M
from tapeloom.operators import outcomes as O
from tapeloom.operators import signals as S
from tapeloom.operators.asof import activate, asof, visible_at_close
from tapeloom.operators.bars import session_masks
from tapeloom.operators.series import Step, chain, ema_alpha, ewm_step, full_avg, prefix_scan, rolling
from tapeloom.operators.indicators import band_stage
from tapeloom.operators.signals import NOISE
from tapeloom.operators.touch import first_touch
from tapeloom.plans.grid import TF_PAIRS, fade_events
from tapeloom.session import stage

# Windows and (stop, target) exits of the average sweep.
MA_WINDOWS = [3, 5, 8, 10, 13, 16, 21, 26, 34, 42, 55, 75, 100, 130, 200]
MA_EXITS = [(0.005, 0.005), (0.005, 0.01), (0.01, 0.005), (0.01, 0.01)]
MA_KINDS = ["sma", "ema"]
SPREAD = 4096


def ma_combos(windows: Sequence[int]) -> list[tuple[str, int, int]]:
    return [(kind, f, s) for kind in MA_KINDS for f, s in itertools.combinations(windows, 2)]


def lines(bars: DataFrame, windows: Sequence[int]) -> DataFrame:
    """``_sma{n}`` and ``_ema{n}`` of the close, NULL until n bars exist."""
    close = F.col("close")
    simple = Step(max(windows), {f"_sma{n}": full_avg("close", n) for n in windows})
    # means of similar decay share a pass
    groups: list[list[int]] = []
    for n in sorted(windows):
        if groups and n + 1 <= 7 * (groups[-1][0] + 1):
            groups[-1].append(n)
        else:
            groups.append([n])
    means = [ewm_step({f"_ema{n}": (close, ema_alpha(n)) for n in g}) for g in groups]
    out = chain(bars, simple, *means)
    return out.withColumns({f"_ema{n}": F.when(F.col("bar_no") >= n - 1, F.col(f"_ema{n}")) for n in windows})


def ma_crosses(bars: DataFrame, windows: Sequence[int]) -> DataFrame:
    """symbol, combo (index into :func:`ma_combos`), bar_no, close, dir, next_no, next_close.

    The fast line crosses when the sign of fast - slow differs from the last sign that was not zero, so the
    events of a pair alternate. Signs of all pairs are one array per bar; only bars where a sign appears or
    changes leave the row.
    """
    names = [f"_{kind}{n}" for kind in MA_KINDS for n in windows]
    pairs = F.array(*[F.struct(F.lit(names.index(f"_{kind}{f}")).alias("i"), F.lit(names.index(f"_{kind}{s}")).alias("j")) for kind, f, s in ma_combos(windows)])
    apart = F.transform(pairs, lambda p: F.get("_a", p.i) - F.get("_a", p.j))
    sign = lambda x: F.when(F.abs(x) <= F.abs(F.col("close")) * NOISE, 0).when(x > 0, 1).when(x < 0, -1)
    valued = lines(bars, windows).select("symbol", "bar_no", "close", F.array(*names).alias("_a"))
    signed = valued.select("symbol", "bar_no", "close", F.transform(apart, sign).alias("_s"))
    signed = rolling(signed, 1, {"_p": lambda w: F.lag("_s").over(w)})
    fresh = F.filter(F.transform("_s", lambda s, i: F.struct(i.alias("combo"), s.alias("dir"), F.get("_p", i).alias("p"))), lambda e: (e.dir != 0) & (e.p.isNull() | (e.p != e.dir)))
    turns = signed.withColumn("_e", F.explode(fresh)).select("symbol", "bar_no", "close", "_e.combo", "_e.dir")
    turns = stage(turns, "turns")
    keys, bucket = ["symbol", "combo"], F.floor(F.col("bar_no") / SPREAD)
    seen = prefix_scan(turns, keys, ["bar_no"], bucket, {"_was": ("last", F.col("dir"))}, inclusive=False)
    events = stage(seen.where(F.col("_was") == -F.col("dir")).drop("_was"), "crosses")
    back = events.withColumn("_r", -F.col("bar_no"))
    ahead = prefix_scan(back, keys, ["_r"], -bucket, {"_next": ("last", F.struct("bar_no", "close"))}, inclusive=False)
    return ahead.select(*keys, "bar_no", "close", "dir", F.col("_next.bar_no").alias("next_no"), F.col("_next.close").alias("next_close"))


def ladder(bars: DataFrame, moves: Sequence[float]) -> DataFrame:
    """symbol, entry_no, price and, per move, the first later bar that trades that far below (``dn``) and above (``up``).

    One row per bar serves every setup that enters at its close: ``dn``/``up`` are arrays of (no, open), one per move.
    """
    sides = [(i, side) for i in range(len(moves)) for side in ("dn", "up")]
    at = {"dn": [F.col("close") * (1 - m) for m in moves], "up": [-(F.col("close") * (1 + m)) for m in moves]}
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("lane"), at[side][i].alias("level")) for i, side in sides])
    probes = bars.select("symbol", F.col("bar_no").alias("after"), F.explode(steps).alias("_p")).select("symbol", "after", "_p.*")
    found = first_touch(probes, bars, {"dn": F.col("low"), "up": -F.col("high")}, carry=["open"])
    cell = F.struct(F.col("touch_no").alias("no"), F.col("open"))
    cells = {f"{side}{i}": F.max(F.when((F.col("lane") == side) & (F.col("i") == i), cell)) for i, side in sides}
    wide = found.groupBy("symbol", F.col("after").alias("entry_no")).agg(*[c.alias(n) for n, c in cells.items()])
    return wide.select("symbol", "entry_no", *[F.array(*[F.col(f"{side}{i}") for i in range(len(moves))]).alias(side) for side in ("dn", "up")])


def ma_trades(bars: DataFrame, windows: Sequence[int] = MA_WINDOWS, exits: Sequence[tuple[float, float]] = MA_EXITS) -> DataFrame:
    """Closed trades of every pair of averages and exit: combo, sl, tp, entry_no, dir, price, exit_no, exit_price, ret.

    Entry at the close of a cross, unless a stock's session ends; exit at the first of stop, target, opposite cross
    and the session's last close. Crosses of a pair alternate, so a pair never holds two positions.
    """
    moves = sorted({m for e in exits for m in e})
    marked = session_masks(bars)
    ends = marked.where("eod").select(F.col("symbol").alias("_of"), F.col("bar_no").alias("_end"), F.col("close").alias("eod_close"))
    # the session's last bar for every bar of a stock
    last = prefix_scan(
        marked.withColumn("_r", -F.col("bar_no")), ["symbol"], ["_r"], -F.floor(F.col("bar_no") / SPREAD),
        {"eod_no": ("last", F.when(F.col("eod"), F.col("bar_no")))},
    )
    open_bars = last.where(~F.col("late") & ~F.col("eod")).select("symbol", F.col("bar_no").alias("entry_no"), "eod_no")
    events = ma_crosses(bars, windows).withColumnRenamed("bar_no", "entry_no").withColumnRenamed("close", "price")
    held = events.join(open_bars, ["symbol", "entry_no"]).join(ladder(bars, moves), ["symbol", "entry_no"])
    held = held.join(ends, (F.col("symbol") == F.col("_of")) & (F.col("eod_no") == F.col("_end")), "left").drop("_of", "_end")
    each = F.array(*[F.struct(F.lit(sl).alias("sl"), F.lit(tp).alias("tp"), F.lit(moves.index(sl)).alias("i"), F.lit(moves.index(tp)).alias("j")) for sl, tp in exits])
    out = held.withColumn("_x", F.explode(each)).select("*", "_x.*").drop("_x")
    is_long = F.col("dir") == 1
    stop = F.when(is_long, F.get("dn", F.col("i"))).otherwise(F.get("up", F.col("i")))
    target = F.when(is_long, F.get("up", F.col("j"))).otherwise(F.get("dn", F.col("j")))
    out = out.withColumns({"_s": stop, "_t": target})
    sl, tp = F.col("price") * (1 - F.col("dir") * F.col("sl")), F.col("price") * (1 + F.col("dir") * F.col("tp"))
    fill = F.when(is_long, F.least("_s.open", sl)).otherwise(F.greatest("_s.open", sl))
    gain = F.when(is_long, F.greatest("_t.open", tp)).otherwise(F.least("_t.open", tp))
    no = F.least("_s.no", "_t.no", "next_no", "eod_no")
    price = F.when(F.col("_s.no") == no, fill).when(F.col("_t.no") == no, gain).when(F.col("next_no") == no, F.col("next_close")).otherwise(F.col("eod_close"))
    out = out.withColumns({"exit_no": no, "exit_price": price}).where(F.col("exit_no").isNotNull())
    ret = F.col("dir") * (div(F.col("exit_price"), F.col("price")) - 1)
    return out.select("symbol", "combo", "sl", "tp", "entry_no", "dir", "price", "exit_no", "exit_price", ret.alias("ret"))


def combo_columns(windows: Sequence[int]) -> list[Column]:
    names = F.array(*[F.struct(F.lit(k).alias("ma_type"), F.lit(f).cast("long").alias("fast"), F.lit(s).cast("long").alias("slow")) for k, f, s in ma_combos(windows)])
    cell = F.get(names, F.col("combo"))
    return [cell[c].alias(c) for c in ("ma_type", "fast", "slow")]


def ma_sweep(bars: DataFrame, fees: Sequence[float], windows: Sequence[int] = MA_WINDOWS, exits: Sequence[tuple[float, float]] = MA_EXITS) -> DataFrame:
    """Net statistics per symbol, kind of average, pair, exit and fee."""
    trades = ma_trades(bars, windows, exits).withColumn("fee", F.explode(F.array(*[F.lit(f) for f in fees])))
    ret = O.net_return(F.col("ret"), F.col("fee"))
    stats = trades.withColumn("ret", ret).groupBy("symbol", "combo", "sl", "tp", "fee").agg(
        F.count(F.lit(1)).alias("n_trades"),
        M.profit_factor(F.col("ret")).alias("profit_factor"),
        M.win_rate_pct(F.col("ret")).alias("win_rate_pct"),
        (F.avg("ret") * 100).alias("avg_trade_pct"),
        M.compounded_pct(F.col("ret")).alias("total_return_pct"),
    )
    return stats.select("symbol", *combo_columns(windows), *[c for c in stats.columns if c not in ("symbol", "combo")])


# ------------------------------------------------------------------ setup and execution timeframes

# Axes of the multi-timeframe grid.
DEVS, TARGETS, LEVELS = [2.0, 2.5], ["r1", "r2", "midband", "opposite"], [0.005, 0.01]
BY = ["setup_tf", "dev", "strict", "adx_filter"]


def stacked(frames: dict[str, DataFrame]) -> DataFrame:
    """Bars of several timeframes as one table; a series is named by timeframe and symbol."""
    out = None
    for tf, bars in frames.items():
        one = bars.select(F.concat(F.lit(f"{tf}|"), "symbol").alias("symbol"), "ts", "bar_no", "open", "high", "low", "close", "volume")
        out = one if out is None else out.unionByName(one)
    return out


def _part(i: int) -> Column:
    return F.split_part(F.col("symbol"), F.lit("|"), F.lit(i))


def on_execution(rows: DataFrame) -> DataFrame:
    """Rows of setup series, once per execution series of their timeframe, with ``setup_tf``."""
    execs = F.coalesce(*[F.when(_part(1) == s, F.array(*map(F.lit, es))) for s, es in TF_PAIRS.items()])
    each = rows.withColumns({"setup_tf": _part(1), "_e": F.explode(execs)})
    return each.withColumn("symbol", F.concat("_e", F.lit("|"), _part(2))).drop("_e")


def mtf_entries(setup: DataFrame, execution: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of every distinct signal setting, unfiltered line events) on the execution series.

    Signals know nothing of targets and fees, so each setting is found once; settings join the targets afterwards.
    """
    nothing, plain = F.lit(None), ["symbol", "ts", "bar_no", "dir", "trigger", "stop"]
    fades = fade_events(setup, DEVS).select(*plain, "dev", "strict", nothing.cast("boolean").alias("adx_filter"))
    raw = stage(S.agulhada(setup), "line-events")
    lines_ = raw.select(*plain, nothing.cast("double").alias("dev"), nothing.cast("boolean").alias("strict"), F.lit(False).alias("adx_filter"))
    ok = S.adx_confirm(setup).select("symbol", "ts", "long_ok", "short_ok")
    strong = raw.join(ok, ["symbol", "ts"]).where(F.when(F.col("dir") == 1, F.col("long_ok")).otherwise(F.col("short_ok")))
    strong = strong.select(*plain, nothing.cast("double").alias("dev"), nothing.cast("boolean").alias("strict"), F.lit(True).alias("adx_filter"))
    events = stage(on_execution(fades.unionByName(lines_).unionByName(strong)), "signals")
    return O.breakout_entries(events, execution, F.col("setup_tf"), by=BY), on_execution(raw)


def _touches(entries: DataFrame, setup: DataFrame, execution: DataFrame) -> DataFrame:
    """Entry id and, per exit name, (no, price) of its first touch from the entry bar on."""
    d, price, risk = F.col("dir"), F.col("price"), F.abs(F.col("price") - F.col("stop"))
    down = d == 1
    fade = F.col("dev").isNotNull()
    exits = [("stop", fade, F.col("stop"), False), ("r1", fade, price + d * risk, True), ("r2", fade, price + d * risk * 2, True)]
    for i, m in enumerate(LEVELS):
        exits += [(f"sl{i}", ~fade, price * (1 - d * m), False), (f"tp{i}", ~fade, price * (1 + d * m), True)]
    # a long is stopped where the low falls to the level and pays where the high rises to it
    rows = F.array(*[F.when(cond, F.struct(F.lit(n).alias("name"), F.lit(gain).alias("gain"), lvl.cast("double").alias("at"))) for n, cond, lvl, gain in exits])
    falls = F.col("gain") != down
    probes = entries.select("id", "symbol", "entry_no", "dir", (F.col("entry_no") - 1).alias("after"), F.explode(F.array_compact(rows)).alias("_x")).select("*", "_x.*").drop("_x")
    probes = probes.withColumns({"lane": F.when(falls, "low").otherwise("high"), "level": F.when(falls, F.col("at")).otherwise(-F.col("at"))})
    hit = first_touch(probes, execution, {"low": F.col("low"), "high": -F.col("high")}, carry=["open"]).where("touch_no is not null")
    opened = F.when(F.col("touch_no") > F.col("entry_no"), F.col("open"))
    levels = hit.select("id", "name", F.struct(F.col("touch_no").alias("no"), F.when(falls, F.least(opened, "at")).otherwise(F.greatest(opened, "at")).alias("price")).alias("cell"))

    banded = rolling(setup, 20, band_stage(20)).select("symbol", "ts", "mid", F.col("_sd").alias("sd"))
    values = visible_at_close(on_execution(banded), F.col("setup_tf"))
    kinds = F.coalesce(*[F.when(_part(1) == e, F.array(*[F.lit(s) for s, es in TF_PAIRS.items() if e in es])) for e in sorted({e for es in TF_PAIRS.values() for e in es})])
    spread = execution.withColumn("setup_tf", F.explode(kinds))
    keys = ["symbol", "setup_tf"]
    path = asof(spread.select(*keys, "ts", "bar_no", "high", "low"), values, keys, value_ts="seen_at", cols={"mid": "mid", "sd": "sd"}, width=5 * 86400)
    lanes, bands = {}, []
    for dev in [0.0, *DEVS]:
        for side in (1, -1):
            at = F.col("mid") + side * dev * F.col("sd")
            lanes[f"{dev:g}{side:+d}"] = at - F.col("high") if side == 1 else F.col("low") - at
    band = F.array(*[F.struct(F.lit(n).alias("name"), F.concat(F.when(F.lit(n) == "midband", "0").otherwise(F.format_string("%s", F.regexp_replace(F.col("dev").cast("string"), r"\.0$", ""))), F.when(down, "+1").otherwise("-1")).alias("lane")) for n in ("midband", "opposite")])
    probes = entries.where(fade).select("id", *keys, "dir", "dev", (F.col("entry_no") - 1).alias("after"), F.lit(0.0).alias("level"), F.explode(band).alias("_x")).select("*", "_x.*").drop("_x")
    path = stage(path, "bands")
    hit = first_touch(probes, path, lanes, keys, carry=["mid", "sd", "high", "low"]).where("touch_no is not null")
    at = F.col("mid") + F.when(F.col("name") == "midband", F.lit(0.0)).otherwise(F.col("dir") * F.col("dev") * F.col("sd"))
    moving = hit.select("id", "name", F.struct(F.col("touch_no").alias("no"), O.band_fill(at).alias("price")).alias("cell"))
    names = [n for n, *_ in exits] + ["midband", "opposite"]
    return levels.unionByName(moving).groupBy("id").agg(*[F.max(F.when(F.col("name") == n, F.col("cell"))).alias("stop_cell" if n == "stop" else n) for n in names])


def mtf_trades(setups: dict[str, DataFrame], executions: dict[str, DataFrame]) -> DataFrame:
    """Trades of the multi-timeframe grid, one position per setting; exits at the first of stop, target, opposite
    line event (fades have none), opposite entry of the setting and a stock's session end."""
    setup, execution = stage(stacked(setups), "setups"), stage(stacked(executions), "executions")
    found, raw = mtf_entries(setup, execution)
    marked = session_masks(execution)
    last = prefix_scan(
        marked.withColumn("_r", -F.col("bar_no")), ["symbol"], ["_r"], -F.floor(F.col("bar_no") / SPREAD),
        {"eod": ("last", F.when(F.col("eod"), F.struct("bar_no", "close")))},
    ).where(~F.col("late"))
    open_bars = last.select("symbol", F.col("bar_no").alias("entry_no"), F.struct(F.col("eod.bar_no").alias("no"), F.col("eod.close").alias("price")).alias("eod"))
    open_bars = open_bars.where("eod.no is null or eod.no > entry_no")
    entries = found.join(open_bars, ["symbol", "entry_no"]).withColumn("id", F.xxhash64("symbol", *BY, "dir", "signal_ts"))
    entries = stage(entries, "entries")
    # what ends a position from outside: the setting's next entry the other way, and for lines the next raw event
    turn = entries.select("symbol", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in BY], (-F.col("dir")).alias("dir"), "entry_ts", F.struct(F.col("entry_no").alias("no"), "price").alias("flip"))
    acts = activate(raw, execution, F.col("setup_tf"), {"bar_no": "act", "ts": "act_ts", "open": "open"})
    acts = acts.groupBy("symbol", F.col("setup_tf").alias("_setup_tf"), (-F.col("dir")).alias("dir"), "act", "act_ts").agg(F.min("open").alias("open"))
    keyed = entries.withColumns({f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in BY})
    keys = ["symbol", *[f"_{c}" for c in BY], "dir"]
    held = asof(keyed, turn.groupBy(*keys, "entry_ts").agg(F.min("flip").alias("flip")), keys, "entry_ts", "entry_ts", {"flip": "flip"}, "forward", allow_equal=False, width=5 * 86400)
    held = asof(held, acts.withColumn("raw", F.struct(F.col("act").alias("no"), F.col("open").alias("price"))), ["symbol", "_setup_tf", "dir"], "entry_ts", "act_ts", {"raw": "raw"}, "forward", allow_equal=False, width=5 * 86400)
    held = held.drop(*[f"_{c}" for c in BY]).join(_touches(entries, setup, execution), "id", "left")
    fade = F.col("dev").isNotNull()
    none = F.lit(None)
    fades = [F.struct(F.lit(t).alias("target"), none.cast("double").alias("sl"), none.cast("double").alias("tp"), F.col("stop_cell").alias("s"), F.col(t).alias("t"), none.cast("struct<no:bigint,price:double>").alias("o")) for t in TARGETS]
    lines_ = [F.struct(none.cast("string").alias("target"), F.lit(a).alias("sl"), F.lit(b).alias("tp"), F.col(f"sl{i}").alias("s"), F.col(f"tp{j}").alias("t"), F.col("raw").alias("o")) for (i, a), (j, b) in itertools.product(enumerate(LEVELS), repeat=2)]
    held = held.withColumn("_x", F.explode(F.when(fade, F.array(*fades)).otherwise(F.array(*lines_)))).select("*", "_x.*")
    no = F.least("s.no", "t.no", "o.no", "flip.no", "eod.no")
    px = F.coalesce(*[F.when(F.col(f"{c}.no") == no, F.col(f"{c}.price")) for c in ("s", "t", "o", "flip", "eod")])
    done = held.withColumns({"exit_no": no, "exit_price": px}).where(F.col("exit_no").isNotNull())
    ends = execution.select(F.col("symbol").alias("_s"), F.col("bar_no").alias("_n"), F.col("ts").alias("exit_ts"))
    done = done.join(ends, (F.col("symbol") == F.col("_s")) & (F.col("exit_no") == F.col("_n")))
    done = done.withColumns({
        "exec_tf": _part(1), "ret": F.col("dir") * (div(F.col("exit_price"), F.col("price")) - 1),
        "setting": F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (*BY, "target", "sl", "tp")]),
    })
    kept = ["symbol", "setting", "exec_tf", *BY, "target", "sl", "tp", "entry_ts", "entry_no", "dir", "price", "exit_ts", "exit_no", "exit_price", "ret"]
    one = O.non_overlapping(done.select(*kept), ["symbol", "setting"], tie=["exit_ts", "dir"])
    return one.withColumn("symbol", _part(2)).drop("setting")


def mtf_sweep(setups: dict[str, DataFrame], executions: dict[str, DataFrame], fees: Sequence[float]) -> DataFrame:
    """Net trades of the whole grid, one row per trade and fee, with the setting's columns."""
    trades = mtf_trades(setups, executions).withColumn("fee", F.explode(F.array(*[F.lit(f) for f in fees])))
    strategy = F.when(F.col("dev").isNotNull(), "fffd").otherwise("didi")
    return trades.withColumns({"ret": O.net_return(F.col("ret"), F.col("fee")), "strategy": strategy})
