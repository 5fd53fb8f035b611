"""Trades: armed breakouts, first-touch exits, costs, single-position selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import full, ny, query, rd, sql
from tapeloom.catalog.signals import band_flags, fffd_sql
from tapeloom.functions.columns import add_tf, ntz, r
from tapeloom.operators import metrics as M
from tapeloom.operators import outcomes as O
from tapeloom.operators import signals as S
from tapeloom.operators import indicators as I
from tapeloom.operators.asof import activate, align_setup
from tapeloom.operators.bars import session_masks
from tapeloom.session import stage
from tapeloom.sources.tables import bars, numbered, trades

H = 24


def next_bar_entries(n, dev: float = 1.5):
    """Band re-entry signals acted on at the close of the first bar after the signal bar."""
    e = activate(S.fffd(n, dev).drop("bar_no"), n, "1h", {"bar_no": "entry_no", "ts": "entry_ts"})
    e = e.groupBy("symbol", "entry_no", "entry_ts", "dir").agg(F.max_by("stop", "ts").alias("stop"))
    e = e.withColumn("price", F.lit(None).cast("double"))
    return O.fill_price(e, n)


ENT = (
    band_flags("stddev_pop", 1.5)
    + ", z AS (" + fffd_sql() + "), "
    "ent AS MATERIALIZED (SELECT symbol, dir, entry_no, entry_ts, arg_max(stop, sts) AS stop, any_value(price) AS price FROM "
    "(SELECT z.symbol, z.ts AS sts, z.dir, z.stop, b.bar_no AS entry_no, b.ts AS entry_ts, b.close AS price FROM "
    "(SELECT *, ts + INTERVAL 1 HOUR AS seen FROM z) z ASOF JOIN n1h b ON z.symbol = b.symbol AND z.seen <= b.ts) GROUP BY 1, 2, 3, 4)"
)


def walk_sql(sl: str, tp: str, first: int = 1, horizon: int = H, more: str = "", more_price: str = "", path: str = "n1h") -> str:
    """First touch of stop, target or time over the bars after each entry."""
    return (
        f"lv AS (SELECT *, {sl} AS sl, {tp} AS tp FROM ent), "
        "wk AS (SELECT lv.*, b.bar_no, b.ts AS bar_ts, b.open, b.high, b.low, b.close, "
        "CASE WHEN dir = 1 THEN b.low <= sl ELSE b.high >= sl END AS stopped, "
        "CASE WHEN dir = 1 THEN b.high >= tp ELSE b.low <= tp END AS hit, b.* EXCLUDE (symbol, bar_no, ts, open, high, low, close) "
        f"FROM lv JOIN {path} b ON b.symbol = lv.symbol AND b.bar_no BETWEEN lv.entry_no + {first} AND lv.entry_no + {horizon}), "
        "rs AS (SELECT *, CASE WHEN coalesce(stopped, false) THEN 'stop' WHEN coalesce(hit, false) THEN 'target' "
        f"{more} WHEN bar_no = entry_no + {horizon} THEN 'time' END AS reason, "
        "CASE WHEN coalesce(stopped, false) THEN CASE WHEN dir = 1 THEN least(open, sl) ELSE greatest(open, sl) END "
        "WHEN coalesce(hit, false) THEN CASE WHEN dir = 1 THEN greatest(open, tp) ELSE least(open, tp) END "
        f"{more_price} ELSE close END AS px FROM wk), "
        "ex AS (SELECT symbol, entry_no, dir, min(bar_no) AS exit_no, arg_min(bar_ts, bar_no) AS exit_ts, arg_min(px, bar_no) AS exit_price, "
        "arg_min(reason, bar_no) AS exit_reason FROM rs WHERE reason IS NOT NULL GROUP BY 1, 2, 3), "
        "tr AS MATERIALIZED (SELECT lv.symbol, lv.entry_no, lv.entry_ts, lv.dir, lv.price, lv.sl, lv.tp, exit_no, exit_ts, exit_price, exit_reason, "
        "lv.dir * (exit_price / lv.price - 1) AS ret FROM lv LEFT JOIN ex USING (symbol, entry_no, dir))"
    )


PCT = walk_sql("price * (1 - dir * 0.5)", "price * (1 + dir * 0.8)")
TR_OUT = (
    "SELECT symbol, entry_ts, CAST(dir AS BIGINT) AS dir, price, exit_ts, exit_reason, "
    f"{rd('exit_price')} AS exit_price, {rd('ret')} AS ret FROM tr"
)


def shown(t):
    return t.select(
        "symbol", ntz(F.col("entry_ts")).alias("entry_ts"), F.col("dir").cast("long").alias("dir"), "price",
        ntz(F.col("exit_ts")).alias("exit_ts"), "exit_reason", r(F.col("exit_price")).alias("exit_price"),
        r(F.col("ret")).alias("ret"),
    )


def pct_trades(spark, sf):
    n = numbered(spark, sf, "1h")
    e = O.with_barriers(next_bar_entries(n), sl=0.5, tp=0.8)
    return O.barrier_outcomes(e, n, H), n


@query("barrier_outcome", sql("n1h", ENT, PCT, TR_OUT))
def barrier_outcome(spark, sf):
    return shown(pct_trades(spark, sf)[0])


@query(
    "fffd_report",
    sql(
        "n1h", ENT, PCT,
        "SELECT symbol, count(*) AS trades, "
        f"{rd('sum(CASE WHEN ret > 0 THEN ret END) / nullif(-sum(CASE WHEN ret < 0 THEN ret END), 0)', 3)} AS profit_factor, "
        f"{rd('100.0 * count(*) FILTER (WHERE ret > 0) / count(*)', 1)} AS win_rate_pct, {rd('100 * avg(ret)', 3)} AS avg_trade_pct "
        "FROM tr WHERE exit_ts IS NOT NULL GROUP BY 1",
    ),
)
def fffd_report(spark, sf):
    t, _ = pct_trades(spark, sf)
    return t.where(F.col("exit_ts").isNotNull()).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"),
        r(M.profit_factor(F.col("ret"), "null"), 3).alias("profit_factor"),
        r(M.win_rate_pct(F.col("ret")), 1).alias("win_rate_pct"),
        r(F.avg("ret") * 100, 3).alias("avg_trade_pct"),
    )


@query("trade_list", sql("n1h", ENT, PCT,
       f"SELECT symbol, CASE WHEN dir = 1 THEN 'long' ELSE 'short' END AS side, entry_ts, exit_ts, {rd('ret')} AS ret, "
       "(exit_no - entry_no) * 3600 AS held_seconds, CASE WHEN exit_reason IN ('stop', 'target') THEN 'intrabar' ELSE 'close' END AS fill "
       "FROM tr WHERE exit_ts IS NOT NULL"))
def trade_list(spark, sf):
    t, _ = pct_trades(spark, sf)
    return t.where(F.col("exit_ts").isNotNull()).select(
        "symbol",
        F.when(F.col("dir") == 1, "long").otherwise("short").alias("side"),
        ntz(F.col("entry_ts")).alias("entry_ts"),
        ntz(F.col("exit_ts")).alias("exit_ts"),
        r(F.col("ret")).alias("ret"),
        ((F.col("exit_no") - F.col("entry_no")) * 3600).alias("held_seconds"),
        F.when(F.col("exit_reason").isin("stop", "target"), "intrabar").otherwise("close").alias("fill"),
    )


RM = walk_sql("CASE WHEN (price - stop) * dir > 0 THEN stop END", "CASE WHEN (price - stop) * dir > 0 THEN price + dir * abs(price - stop) * 2 END")


@query("r_multiple", sql("n1h", ENT, RM, TR_OUT))
def r_multiple(spark, sf):
    """Structural stop with a target at twice its distance; a stop on the wrong side is no stop."""
    n = numbered(spark, sf, "1h")
    distance = (F.col("price") - F.col("stop")) * F.col("dir") / F.col("price")
    valid = F.when((F.col("price") - F.col("stop")) * F.col("dir") > 0, F.col("stop"))
    e = next_bar_entries(n).withColumn("sl_level", valid).withColumn(
        "tp_level", F.col("price") + F.col("dir") * F.abs(F.col("price") - valid) * 2
    )
    return shown(O.barrier_outcomes(e, n, H))


BAND_PATH = (
    "q AS (SELECT *, ts + INTERVAL 4 HOUR AS seen, " + full("avg(close)", 10) + " AS mid4 FROM n4h), "
    f"eo AS (SELECT symbol, bar_no, ts = max(ts) OVER (PARTITION BY symbol, CAST({ny('ts')} AS DATE)) AS eod FROM n1h), "
    "op AS (SELECT symbol, entry_no AS bar_no, max(dir) AS opposite FROM ent GROUP BY 1, 2 HAVING count(*) = 1), "
    "pb AS MATERIALIZED (SELECT n.*, mid4, eod, opposite FROM n1h n ASOF LEFT JOIN q ON n.symbol = q.symbol AND n.ts >= q.seen "
    "LEFT JOIN eo ON eo.symbol = n.symbol AND eo.bar_no = n.bar_no LEFT JOIN op ON op.symbol = n.symbol AND op.bar_no = n.bar_no)"
)
BAND = walk_sql(
    "price * (1 - dir * 0.9)", "NULL::DOUBLE",
    more="WHEN coalesce(CASE WHEN dir = 1 THEN high >= mid4 ELSE low <= mid4 END, false) THEN 'band' "
         "WHEN coalesce(opposite = -dir, false) THEN 'opposite' WHEN coalesce(eod, false) THEN 'eod'",
    more_price="WHEN coalesce(CASE WHEN dir = 1 THEN high >= mid4 ELSE low <= mid4 END, false) THEN least(greatest(mid4, low), high) "
               "WHEN coalesce(opposite = -dir, false) THEN open",
    path="pb",
)


@query("band_target", sql("n1h n4h", ENT, BAND_PATH, BAND, TR_OUT))
def band_target(spark, sf):
    """Stop, moving mid-band target, opposite signal, session end: whichever comes first."""
    n = numbered(spark, sf, "1h")
    e = next_bar_entries(n)
    mid = I.sma(numbered(spark, sf, "4h"), [10])
    flags = session_masks(align_setup(n, mid, "4h", {"sma_10": "band_long"})).withColumn("band_short", F.col("band_long"))
    turn = e.groupBy("symbol", F.col("entry_no").alias("bar_no")).agg(
        F.max("dir").alias("opposite"), F.count(F.lit(1)).alias("_n")
    ).where("_n = 1").drop("_n")
    flags = flags.select("symbol", "bar_no", "band_long", "band_short", "eod").join(turn, ["symbol", "bar_no"], "left")
    return shown(O.barrier_outcomes(O.with_barriers(e, sl=0.9), n, H, flags=flags))


@query(
    "time_exit",
    sql("n1h", ENT, "SELECT ent.symbol, entry_ts, CAST(dir AS BIGINT) AS dir, b.ts AS exit_ts, b.close AS exit_price, "
        f"{rd('dir * (b.close / price - 1)')} AS ret FROM ent LEFT JOIN n1h b ON b.symbol = ent.symbol AND b.bar_no = entry_no + 12"),
)
def time_exit(spark, sf):
    n = numbered(spark, sf, "1h")
    t = O.time_exits(next_bar_entries(n), n, 12)
    return t.select(
        "symbol", ntz(F.col("entry_ts")).alias("entry_ts"), F.col("dir").cast("long").alias("dir"),
        ntz(F.col("exit_ts")).alias("exit_ts"), "exit_price", r(F.col("ret")).alias("ret"),
    )


TRAIL = (
    "wk AS (SELECT ent.*, b.bar_no, b.ts AS bar_ts, b.open, b.high, b.low, b.close, "
    "CASE WHEN dir = 1 THEN greatest(price, max(b.high) OVER w) ELSE least(price, min(b.low) OVER w) END AS peak "
    f"FROM ent JOIN n1h b ON b.symbol = ent.symbol AND b.bar_no BETWEEN entry_no + 1 AND entry_no + {H} "
    "WINDOW w AS (PARTITION BY ent.symbol, entry_no, dir ORDER BY b.bar_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "w2 AS (SELECT *, peak * (1 - dir * 0.6) AS lvl FROM wk), "
    "w3 AS (SELECT *, CASE WHEN dir = 1 THEN low <= lvl ELSE high >= lvl END AS hit FROM w2), "
    "ex AS (SELECT symbol, entry_no, dir, arg_min(bar_ts, bar_no) AS exit_ts, "
    "arg_min(CASE WHEN hit THEN CASE WHEN dir = 1 THEN least(open, lvl) ELSE greatest(open, lvl) END ELSE close END, bar_no) AS exit_price, "
    f"arg_min(CASE WHEN hit THEN 'trail' ELSE 'time' END, bar_no) AS exit_reason FROM w3 WHERE hit OR bar_no = entry_no + {H} GROUP BY 1, 2, 3), "
    "tr AS (SELECT ent.*, exit_ts, exit_price, exit_reason, ent.dir * (exit_price / price - 1) AS ret FROM ent LEFT JOIN ex USING (symbol, entry_no, dir))"
)


@query("trailing_outcome", sql("n1h", ENT, TRAIL, TR_OUT))
def trailing_outcome(spark, sf):
    n = numbered(spark, sf, "1h")
    return shown(O.trailing_outcomes(next_bar_entries(n), n, 0.6, H))


def brk_cte(same_session: bool = False) -> str:
    """Each execution bar looks back to the newest armed signal of a side; first break wins."""
    day = f"CAST({ny('ts')} AS DATE)"
    session = (
        f"AND {day.replace('ts', 'act_ts')} = sig_day " if same_session else ""
    )
    exp = "least(exp_no, last_no)" if same_session else "exp_no"
    return (
        band_flags("stddev_pop", 1.5) + ", z AS (" + fffd_sql() + "), "
        f"dd AS MATERIALIZED (SELECT *, {day} AS day, max(bar_no) OVER (PARTITION BY symbol, {day}) AS last_no FROM n15m), "
        "a1 AS (SELECT z.*, b.bar_no AS act, b.ts AS act_ts, b.last_no, b.day AS act_day FROM (SELECT *, ts + INTERVAL 1 HOUR AS seen FROM z) z "
        "ASOF JOIN dd b ON z.symbol = b.symbol AND z.seen <= b.ts), "
        "a2 AS (SELECT a1.*, b.bar_no AS exp_no FROM (SELECT *, ts + INTERVAL 3 HOUR AS exp_ts FROM a1) a1 "
        "ASOF LEFT JOIN n15m b ON a1.symbol = b.symbol AND a1.exp_ts > b.ts), "
        "a3 AS (SELECT a2.*, b.day AS sig_day FROM a2 ASOF LEFT JOIN dd b ON a2.symbol = b.symbol AND a2.ts <= b.ts), "
        f"a4 AS (SELECT *, {exp} AS last_live FROM a3 WHERE true {'AND act_day = sig_day' if same_session else ''}), "
        "one AS MATERIALIZED (SELECT symbol, dir, act, max(ts) AS ts, arg_max(trigger, ts) AS trigger, arg_max(stop, ts) AS stop, "
        "arg_max(last_live, ts) AS last_live FROM a4 GROUP BY 1, 2, 3), "
        "sides AS (SELECT *, 1 AS side FROM n15m UNION ALL SELECT *, -1 FROM n15m), "
        "look AS (SELECT s.*, o.ts AS signal_ts, o.trigger, o.stop, o.last_live FROM sides s ASOF JOIN one o "
        "ON s.symbol = o.symbol AND s.side = o.dir AND s.bar_no >= o.act), "
        "fire AS (SELECT * FROM look WHERE bar_no <= last_live AND CASE WHEN side = 1 THEN high > trigger ELSE low < trigger END), "
        "ft AS (SELECT symbol, side, signal_ts, min(bar_no) AS bar_no FROM fire GROUP BY 1, 2, 3), "
        "brk AS MATERIALIZED (SELECT symbol, signal_ts, ts AS entry_ts, bar_no AS entry_no, side AS dir, stop, "
        "CASE WHEN side = 1 THEN greatest(open, trigger) ELSE least(open, trigger) END AS price FROM fire JOIN ft USING (symbol, side, signal_ts, bar_no))"
    )


BRK_OUT = (
    f"SELECT symbol, signal_ts, entry_ts, CAST(dir AS BIGINT) AS dir, price, {rd('(price - stop) * dir / price')} AS stop_pct FROM brk"
)


def brk_shown(e):
    return e.select(
        "symbol", ntz(F.col("signal_ts")).alias("signal_ts"), ntz(F.col("entry_ts")).alias("entry_ts"),
        F.col("dir").cast("long").alias("dir"), "price", r(F.col("stop_pct")).alias("stop_pct"),
    )


@query("breakout_entries", sql("n1h n15m", brk_cte(), BRK_OUT))
def breakout_entries(spark, sf):
    return brk_shown(O.breakout_entries(S.fffd(numbered(spark, sf, "1h"), 1.5), numbered(spark, sf, "15min"), "1h"))


@query("breakout_intraday", sql("n1h n15m", brk_cte(True), BRK_OUT))
def breakout_intraday(spark, sf):
    return brk_shown(
        O.breakout_entries(
            S.fffd(numbered(spark, sf, "1h"), 1.5), numbered(spark, sf, "15min"), "1h", same_session=True
        )
    )


MFE = (
    "mf AS (SELECT tr.symbol, tr.entry_ts, tr.entry_no, tr.dir, CASE WHEN tr.dir = 1 THEN max(b.high) / any_value(price) - 1 "
    "ELSE 1 - min(b.low) / any_value(price) END AS mfe FROM tr JOIN n1h b ON b.symbol = tr.symbol AND b.bar_no BETWEEN tr.entry_no AND tr.exit_no "
    "GROUP BY 1, 2, 3, 4)"
)
MFE_IDS = ["symbol", "entry_ts", "entry_no", "dir"]


@query("mfe", sql("n1h", ENT, PCT, MFE, f"SELECT symbol, entry_ts, CAST(dir AS BIGINT) AS dir, {rd('mfe')} AS mfe FROM mf"))
def mfe(spark, sf):
    t, n = pct_trades(spark, sf)
    m = O.excursions(t, n, MFE_IDS)
    return m.select(
        "symbol", ntz(F.col("entry_ts")).alias("entry_ts"), F.col("dir").cast("long").alias("dir"), r(F.col("mfe")).alias("mfe")
    )


@query(
    "mfe_quantiles",
    sql("n1h", ENT, PCT, MFE,
        "SELECT symbol, count(*) AS n, " + ", ".join(f"{rd(f'quantile_cont(mfe, {q})')} AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9))
        + f", {rd('avg(CASE WHEN mfe >= 0.005 THEN 1 ELSE 0 END)')} AS share_half_pct, {rd('avg(CASE WHEN mfe >= 0.01 THEN 1 ELSE 0 END)')} AS share_one_pct "
        "FROM mf GROUP BY 1"),
)
def mfe_quantiles(spark, sf):
    t, n = pct_trades(spark, sf)
    m = stage(O.excursions(t, n, MFE_IDS), "excursions")
    qs = M.quantiles(m, ["symbol"], "mfe", {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9})
    share = lambda x: F.avg(F.when(F.col("mfe") >= x, 1.0).otherwise(0.0))
    agg = m.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), share(0.005).alias("share_half_pct"), share(0.01).alias("share_one_pct")
    )
    joined = agg.join(qs, "symbol")
    return joined.select("symbol", "n", *[r(F.col(c)).alias(c) for c in ("q25", "q50", "q75", "q90", "share_half_pct", "share_one_pct")])


# ---------------------------------------------------------------- on the trade table

TIE = ["order_id", "line_no", "part_id", "qty", "ret", "fee", "notional", "cfg"]
NONOV = (
    f"nt AS MATERIALIZED (SELECT *, entry_ts + INTERVAL 1 DAY * CAST(qty AS INTEGER) AS xts, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts, {', '.join(TIE)}) AS no FROM trades), "
    "fs AS (SELECT symbol, entry_ts, min(no) AS no FROM nt GROUP BY 1, 2), "
    "lk AS MATERIALIZED (SELECT a.symbol, a.no, b.no AS nxt FROM nt a ASOF LEFT JOIN fs b ON a.symbol = b.symbol AND a.xts <= b.entry_ts), "
    "ch AS (SELECT symbol, no, nxt FROM lk WHERE no = 1 UNION ALL SELECT lk.symbol, lk.no, lk.nxt FROM ch JOIN lk ON lk.symbol = ch.symbol AND lk.no = ch.nxt)"
)


@query(
    "non_overlap",
    sql("trades", NONOV, "SELECT nt.symbol, nt.entry_ts, nt.xts AS exit_ts, order_id, line_no, ret FROM nt JOIN ch USING (symbol, no)", recursive=True),
)
def non_overlap(spark, sf):
    """Trades that last qty days, taken one at a time per symbol."""
    t = trades(spark, sf).withColumn(
        "exit_ts", F.timestamp_micros(F.unix_micros("entry_ts") + F.col("qty").cast("long") * F.lit(86_400_000_000))
    )
    kept = O.non_overlapping(t, ["symbol"], tie=TIE)
    return kept.select(
        "symbol", ntz(F.col("entry_ts")).alias("entry_ts"), ntz(F.col("exit_ts")).alias("exit_ts"), "order_id", "line_no", "ret"
    )


@query(
    "net_returns",
    sql("trades", "SELECT symbol, order_id, line_no, part_id, qty, cfg, "
        f"{rd('ret - 2 * (fee / 100 + 0.0001)')} AS net_ret, {rd('200 * (fee / 100 - 0.001)')} AS restated_pct, "
        f"{rd('2 * greatest(0, 1.0 / nullif(CASE WHEN symbol % 2 = 0 THEN 100 ELSE 1000 END, 0) * 100 - fee)')} AS min_fee_pct, "
        f"{rd('CASE WHEN symbol % 2 = 0 THEN 100 ELSE 1000 END * (ret - 2 * (fee / 100 + 0.0001))')} AS pnl_usd FROM trades"),
)
def net_returns(spark, sf):
    t = trades(spark, sf)
    stake = F.when(F.col("symbol") % 2 == 0, 100.0).otherwise(1000.0)
    net = O.net_return(F.col("ret"), F.col("fee") / 100)
    return t.select(
        "symbol", "order_id", "line_no", "part_id", "qty", "cfg", r(net).alias("net_ret"),
        r(O.restate_fee_pct(F.col("fee") / 100, F.lit(0.001))).alias("restated_pct"),
        r(O.minimum_fee_shortfall_pct(1.0, stake, F.col("fee"))).alias("min_fee_pct"),
        r(stake * net).alias("pnl_usd"),
    )


@query(
    "paper_pnl",
    sql("trades", "SELECT symbol, order_id, line_no, part_id, cfg, side, "
        f"{rd('(px2 - px) * qty * sgn - (px + px2) * qty * 0.0005', 9)} AS pnl_usd, {rd('100 * sgn * (px2 / px - 1)')} AS pnl_pct "
        "FROM (SELECT *, notional / qty AS px, notional / qty * (1 + ret) AS px2, CASE WHEN side = 'long' THEN 1 ELSE -1 END AS sgn FROM trades)"),
)
def paper_pnl(spark, sf):
    t = trades(spark, sf).withColumn("px", F.col("notional") / F.col("qty"))
    t = t.withColumn("px2", F.col("px") * (1 + F.col("ret")))
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    pnl = O.closed_pnl(F.col("side"), F.col("qty"), F.col("px"), F.col("px2"), F.lit(O.SLIPPAGE_PAPER))
    return t.select(
        "symbol", "order_id", "line_no", "part_id", "cfg", "side", r(pnl, 9).alias("pnl_usd"),
        r(100 * sign * (F.col("px2") / F.col("px") - 1)).alias("pnl_pct"),
    )
