"""Runs a table of configurations: entry family, gate, exit, one position, net metrics, in one plan.

A configuration is a dict: ``entry`` (``kind`` and the family's parameters), ``setup_tf``, ``gate`` (None or ``ind`` and its
parameters), ``exit`` (``sl``, ``tp``, ``max_bars``; each may be missing) and ``fee``. Signals, gates and first touches are
found once per distinct setting and joined to the table of configurations; fees only price the trades.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.columns import div
from tapeloom.operators import outcomes as O
from tapeloom.operators import signals as S
from tapeloom.operators.asof import asof
from tapeloom.operators.bars import session_masks
from tapeloom.operators.gates import GATES
from tapeloom.operators.series import prefix_scan
from tapeloom.operators.touch import first_touch
from tapeloom.session import stage

SPREAD = 4096
# Axes of the lab grid.
EXITS = [(0.005, 0.005), (0.005, 0.01), (0.01, 0.005), (0.01, 0.01)]
RANGES, TIMED_RANGES, TIMES = [15, 30, 60], [30, 60], [24, 48]
MODES, BANDS = ["revert", "cross"], [1.0, 1.5, 2.0]
RSI_FRAMES, RSI_LEVELS = ["30min", "1h"], [(30, 70), (20, 80)]
# What makes a setting viable on a symbol, and the families that are refined.
VIABLE_TRADES, VIABLE_FACTOR, FAMILIES = 30, 1.1, 10


def lab_grid(exec_tf: str, fees: Sequence[float]) -> list[dict]:
    """Opening range, session VWAP and RSI crosses: 56 settings per fee."""
    out = []
    for minutes, (sl, tp) in itertools.product(RANGES, EXITS):
        out.append({"entry": {"kind": "orb", "range_min": minutes}, "exit": {"sl": sl, "tp": tp}})
    for minutes, n in itertools.product(TIMED_RANGES, TIMES):
        out.append({"entry": {"kind": "orb", "range_min": minutes}, "exit": {"sl": 0.01, "max_bars": n}})
    for mode, k, (sl, tp) in itertools.product(MODES, BANDS, EXITS):
        out.append({"entry": {"kind": "vwap", "mode": mode, "band_k": k}, "exit": {"sl": sl, "tp": tp}})
    for tf, (lo, hi), (sl, tp) in itertools.product(RSI_FRAMES, RSI_LEVELS, EXITS):
        out.append({"entry": {"kind": "rsi_cross", "window": 14, "lo": lo, "hi": hi}, "setup_tf": tf, "exit": {"sl": sl, "tp": tp}})
    return [{"setup_tf": exec_tf, "gate": None} | c | {"fee": f} for c in out for f in fees]


def name(spec) -> str:
    return "-" if spec is None else json.dumps(spec, sort_keys=True, separators=(",", ":"))


def label(config: dict) -> str:
    """Human label of a configuration, without its fee."""
    entry, leave, gate = config["entry"], config["exit"], config["gate"]
    bits = [f"{entry['kind']} {config['setup_tf']}", *(f"{k} {v}" for k, v in entry.items() if k != "kind")]
    bits.append("exit " + " ".join(f"{k}={v}" for k, v in leave.items()))
    if gate:
        bits.append(" ".join(["gate", gate["ind"], *(f"{k} {v}" for k, v in gate.items() if k != "ind")]))
    return " · ".join(bits)


def _union(parts: Iterable[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def run_table(configs: Sequence[dict], frames: dict[str, DataFrame], exec_tf: str) -> DataFrame:
    """Closed trades of every configuration: symbol, label, fee, entry_ts, dir, price, exit_ts, exit_price, exit_reason, ret.

    Entries without a price fill at their bar's close; exits are watched from the next bar: stop, target, an opposite
    entry of the same setting, ``max_bars`` and a stock's session end, in this order on one bar. ``ret`` is net of fee
    and slippage. Entry parameters and gates are few and known to the driver; bars never are.
    """
    bars = frames[exec_tf]
    spark = bars.sparkSession
    signals = {(name(c["entry"]), c["setup_tf"]): c["entry"] for c in configs}
    found = []
    for (key, tf), entry in signals.items():
        params = {k: v for k, v in entry.items() if k != "kind"}
        e = S.generate(entry["kind"], frames[tf], bars, tf, params)
        found.append(e.select("symbol", "entry_ts", "entry_no", "dir", "price", F.lit(f"{key}@{tf}").alias("sig")))
    entries = stage(O.fill_price(_union(found), bars), "entries")
    gates = {name(c["gate"]): c["gate"] for c in configs if c["gate"]}
    open_for = []
    for key, spec in gates.items():
        flags = GATES[spec["ind"]](bars, frames, **{k: v for k, v in spec.items() if k != "ind"})
        sides = F.array_compact(F.array(F.when(F.col("long_ok"), F.lit(1)), F.when(F.col("short_ok"), F.lit(-1))))
        open_for.append(flags.select("symbol", F.col("bar_no").alias("entry_no"), F.lit(key).alias("gate"), F.explode(sides).alias("dir")))

    settings = {label(c): (f"{name(c['entry'])}@{c['setup_tf']}", name(c["gate"]), *(c["exit"].get(k) for k in ("sl", "tp", "max_bars"))) for c in configs}
    table = spark.createDataFrame([(k, *v) for k, v in settings.items()], "label string, sig string, gate string, sl double, tp double, max_bars int")
    fees = spark.createDataFrame(sorted({(label(c), float(c["fee"])) for c in configs}), "label string, fee double")
    held = entries.join(table, "sig")
    if open_for:
        gated = held.where("gate <> '-'").join(_union(open_for), ["symbol", "entry_no", "gate", "dir"], "left_semi")
        held = held.where("gate = '-'").unionByName(gated)
    last = prefix_scan(
        session_masks(bars).withColumn("_r", -F.col("bar_no")), ["symbol"], ["_r"], -F.floor(F.col("bar_no") / SPREAD),
        {"eod": ("last", F.when(F.col("eod"), F.struct(F.col("bar_no").alias("no"), F.col("close").alias("price"))))},
    ).where(~F.col("late"))
    blocked = last.where("eod is null or eod.no > bar_no").select("symbol", F.col("bar_no").alias("entry_no"), "eod")
    held = stage(held.join(blocked, ["symbol", "entry_no"]), "held")

    # each distinct level is looked up once, whichever settings share it
    sides = F.array_compact(F.array(
        F.when(F.col("sl").isNotNull(), F.struct(F.lit("s").alias("what"), F.col("sl").alias("frac"))),
        F.when(F.col("tp").isNotNull(), F.struct(F.lit("t").alias("what"), F.col("tp").alias("frac"))),
    ))
    levels = held.select("symbol", "entry_no", "dir", "price", F.explode(sides).alias("_x")).select("symbol", "entry_no", "dir", "price", "_x.*").distinct()
    at = F.when(F.col("what") == "s", F.col("price") * (1 - F.col("dir") * F.col("frac"))).otherwise(F.col("price") * (1 + F.col("dir") * F.col("frac")))
    falls = (F.col("dir") == 1) == (F.col("what") == "s")
    probes = levels.withColumns({"after": F.col("entry_no"), "at": at, "lane": F.when(falls, "low").otherwise("high")})
    probes = probes.withColumn("level", F.when(falls, F.col("at")).otherwise(-F.col("at")))
    hit = first_touch(probes, bars, {"low": F.col("low"), "high": -F.col("high")}, carry=["open"]).where("touch_no is not null")
    fill = F.when(falls, F.least("open", "at")).otherwise(F.greatest("open", "at"))
    hit = stage(hit.select("symbol", "entry_no", "dir", "price", "what", "frac", F.struct(F.col("touch_no").alias("no"), fill.alias("price")).alias("cell")), "touches")

    def touched(what: str, by: str, out: str) -> DataFrame:
        return hit.where(F.col("what") == what).select("symbol", "entry_no", "dir", "price", F.col("frac").alias(by), F.col("cell").alias(out))

    keys = ["symbol", "entry_no", "dir", "price"]
    done = held.join(touched("s", "sl", "s"), [*keys, "sl"], "left").join(touched("t", "tp", "t"), [*keys, "tp"], "left")
    late = bars.select("symbol", F.col("bar_no").alias("_no"), F.col("close").alias("_close"))
    done = done.join(late, (done["symbol"] == late["symbol"]) & (F.col("entry_no") + F.col("max_bars") == F.col("_no")), "left").drop(late["symbol"])
    turn = held.groupBy("symbol", "label", (-F.col("dir")).alias("dir"), "entry_ts").agg(F.min(F.struct(F.col("entry_no").alias("no"), "price")).alias("flip"))
    done = asof(done, turn, ["symbol", "label", "dir"], "entry_ts", "entry_ts", {"flip": "flip"}, "forward", allow_equal=False, width=5 * 86400)
    done = done.withColumn("time", F.when(F.col("_no").isNotNull(), F.struct(F.col("_no").alias("no"), F.col("_close").alias("price"))))
    ways = {"stop": "s", "target": "t", "opposite": "flip", "time": "time", "eod": "eod"}
    no = F.least(*[f"{c}.no" for c in ways.values()])
    first = F.coalesce(*[F.when(F.col(f"{c}.no") == no, F.struct(F.lit(w).alias("exit_reason"), F.col(f"{c}.price").alias("exit_price"))) for w, c in ways.items()])
    done = done.withColumns({"exit_no": no, "_x": first}).where("exit_no is not null")
    ends = bars.select(F.col("symbol").alias("_s"), F.col("bar_no").alias("_n"), F.col("ts").alias("exit_ts"))
    done = done.join(ends, (F.col("symbol") == F.col("_s")) & (F.col("exit_no") == F.col("_n")))
    gross = F.col("dir") * (div(F.col("_x.exit_price"), F.col("price")) - 1)
    done = done.select("symbol", "label", "entry_ts", "entry_no", "dir", "price", "exit_ts", "exit_no", "_x.exit_price", "_x.exit_reason", gross.alias("gross"))
    one = O.non_overlapping(done, ["symbol", "label"], tie=["exit_ts", "dir"])
    return one.join(fees, "label").withColumn("ret", O.net_return(F.col("gross"), F.col("fee"))).drop("gross")


def funnel(
    frames: dict[str, DataFrame],
    coarse_tf: str,
    refine_tf: str,
    fees: Sequence[float],
    report: Callable[[DataFrame], DataFrame],
    min_trades: int = VIABLE_TRADES,
    min_factor: float = VIABLE_FACTOR,
) -> DataFrame:
    """Coarse grid, score, and the second grid that the scores call for.

    ``report`` turns trades into rows of symbol, label, fee, n, pf. The coarse grid runs everywhere; a family counts the
    symbols on which it is viable at the lowest fee, and the best families run again on the finer bars, only where they
    were viable. Rows: symbol, label (of the coarse setting), n_viable, median_pf and the report's columns of the finer run.
    """
    grid = lab_grid(coarse_tf, fees)
    coarse = stage(report(run_table(grid, frames, coarse_tf)), "coarse")
    viable = coarse.where((F.col("fee") == min(fees)) & (F.col("n") >= min_trades) & (F.col("pf") >= min_factor)).select("symbol", "label", "pf")
    families = viable.groupBy("label").agg(F.count(F.lit(1)).alias("n_viable"), F.expr("percentile(pf, 0.5)").alias("median_pf"))
    best = families.orderBy(F.desc("n_viable"), F.desc("median_pf"), "label").limit(FAMILIES)
    kept = {r.label: (r.n_viable, r.median_pf) for r in best.collect()}  # FAMILIES rows at most
    finer = [{**c, "setup_tf": refine_tf if c["setup_tf"] == coarse_tf else c["setup_tf"]} for c in grid if label(c) in kept]
    names = sorted({(label({**c, "setup_tf": coarse_tf if c["setup_tf"] == refine_tf else c["setup_tf"]}), label(c)) for c in finer})
    spark = coarse.sparkSession
    scored = spark.createDataFrame([(fine, was, *map(float, kept[was])) for was, fine in names], "label string, was string, n_viable double, median_pf double")
    if not finer:
        return coarse.limit(0).withColumns({"n_viable": F.lit(0).cast("long"), "median_pf": F.lit(0.0)})
    found = report(run_table(finer, frames, refine_tf)).join(scored, "label")
    wanted = viable.select("symbol", F.col("label").alias("was"))
    found = found.join(wanted, ["symbol", "was"], "left_semi").drop("label").withColumnRenamed("was", "label")
    return found.withColumn("n_viable", F.col("n_viable").cast("long"))
