"""Grids, sweeps, walk-forward, league and robustness."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tapeloom.catalog.base import COMPOUND, GROWTH, ewm_cte, full, lagged, ny, query, rd, rsi_cte, sql
from tapeloom.catalog.metrics import DAYPNL, DD, group_columns, GROUP_COLS, oos_columns, pf_sql
from tapeloom.catalog.signals import ADX_OK, AGU
from tapeloom.catalog.outcomes import ENT, PCT, TIE, next_bar_entries, pct_trades
from tapeloom.functions.columns import add_tf, div, floor_ts, ntz, r, tf_seconds
from tapeloom.operators import gates as G
from tapeloom.operators import metrics as M
from tapeloom.operators import outcomes as O
from tapeloom.operators.bars import daily_last
from tapeloom.operators.registry import best_per
from tapeloom.operators.series import DAY
from tapeloom.plans import grid as GR
from tapeloom.plans import league as L
from tapeloom.plans import robustness as RB
from tapeloom.plans import sweep as SW
from tapeloom.plans import validate as V
from tapeloom.session import stage
from tapeloom.sources.tables import bars, numbered, runs, table, trades

# ---------------------------------------------------------------- grids

PAIRS = "pr AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', '{e}')" for s, es in GR.TF_PAIRS.items() for e in es
) + ") v(setup_tf, exec_tf))"
GRID = (
    "sy AS (SELECT s_suppkey AS symbol FROM supplier), fe AS (SELECT unnest([0.001, 0.0025])::DOUBLE AS fee), "
    "fd AS (SELECT symbol, setup_tf, exec_tf, dev, strict, target, fee FROM sy, pr, (SELECT unnest([2.0, 2.5])::DOUBLE AS dev), "
    "(SELECT unnest([true, false]) AS strict), (SELECT unnest(['r1', 'r2', 'midband', 'opposite']) AS target), fe), "
    "dd AS (SELECT symbol, setup_tf, exec_tf, adx_filter, sl, tp, fee FROM sy, pr, (SELECT unnest([true, false]) AS adx_filter), "
    "(SELECT unnest([0.005, 0.01])::DOUBLE AS sl), (SELECT unnest([0.005, 0.01])::DOUBLE AS tp), fe)"
)


@query(
    "grid_expand",
    sql("", PAIRS, GRID,
        "SELECT symbol, 'fffd' AS strategy, fee, 'FFFD ' || setup_tf || '→' || exec_tf || ' · ' || CASE WHEN strict THEN 'strict' ELSE 'loose' END "
        "|| ' · dev ' || dev || ' · ' || target AS label FROM fd UNION ALL "
        "SELECT symbol, 'didi', fee, 'Didi ' || setup_tf || '→' || exec_tf || CASE WHEN adx_filter THEN ' · ADX' ELSE '' END "
        "|| ' · sl ' || round(sl * 100, 1) || '% · tp ' || round(tp * 100, 1) || '%' FROM dd"),
)
def grid_expand(spark, sf):
    symbols = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"))
    g = GR.mtf_grid(symbols, [0.001, 0.0025])
    return g.select("symbol", "strategy", "fee", GR.label(g).alias("label"))


FEES = [0.001, 0.0025]
MA_MOVES = sorted({m for e in SW.MA_EXITS for m in e})
COMBOS = SW.ma_combos(SW.MA_WINDOWS)


def ladder_sql(source, moves):
    """First later bar at each distance below (d0, d1, ..) and above (u0, u1, ..) a bar's close."""
    cells = ", ".join(
        f"min(b.bar_no) FILTER (b.low <= a.close * {1 - m!r}::DOUBLE) AS d{i}, min(b.bar_no) FILTER (b.high >= a.close * {1 + m!r}::DOUBLE) AS u{i}" for i, m in enumerate(moves)
    )
    return f"ld AS MATERIALIZED (SELECT a.symbol, a.bar_no, {cells} FROM {source} a JOIN {source} b ON a.symbol = b.symbol AND b.bar_no > a.bar_no GROUP BY 1, 2)"


def session_sql(source):
    """late, eod and the session's last bar of stocks."""
    day = f"CAST({ny('ts')} AS DATE)"
    return (
        f"ss AS MATERIALIZED (SELECT symbol, bar_no, date_part('hour', {ny('ts')}) * 60 + date_part('minute', {ny('ts')}) >= 945 AS late, "
        f"ts = max(ts) OVER w AS eod, max(bar_no) OVER w AS eod_no, arg_max(close, ts) OVER w AS eod_close FROM {source} WINDOW w AS (PARTITION BY symbol, {day}))"
    )


MA_SQL = (
    ", ".join(ewm_cte(f"e{n}", "n15m", {f"e{n}": "close"}, f"(2.0::DOUBLE / {n + 1})") for n in SW.MA_WINDOWS)
    + ", sm AS MATERIALIZED (SELECT symbol, bar_no, close, [" + ", ".join(full("avg(close)", n) for n in SW.MA_WINDOWS)
    + "] AS b FROM n15m), m AS MATERIALIZED (SELECT sm.symbol, sm.bar_no, sm.close, list_concat(b, [" + ", ".join(f"CASE WHEN sm.bar_no >= {n - 1} THEN e{n}.e{n} END" for n in SW.MA_WINDOWS) + "]) AS a FROM sm "
    + " ".join(f"JOIN e{n} ON e{n}.symbol = sm.symbol AND e{n}.bar_no = sm.bar_no" for n in SW.MA_WINDOWS)
    + "), pr AS (SELECT * FROM (VALUES " + ", ".join(
        f"({c}, '{k}', {f}, {s}, {SW.MA_WINDOWS.index(f) + 1 + 15 * (k == 'ema')}, {SW.MA_WINDOWS.index(s) + 1 + 15 * (k == 'ema')})" for c, (k, f, s) in enumerate(COMBOS)
    ) + ") v(combo, ma_type, fast, slow, i, j)), "
    "x AS (SELECT symbol, combo, bar_no, close, CASE WHEN abs(a[i] - a[j]) <= close * 1e-12 THEN 0 ELSE sign(a[i] - a[j]) END AS s FROM m, pr WHERE a[i] - a[j] IS NOT NULL), "
    "y AS (SELECT *, lag(s) OVER (PARTITION BY symbol, combo ORDER BY bar_no) AS was FROM x WHERE s <> 0), "
    "ev AS MATERIALIZED (SELECT symbol, combo, bar_no, close, s AS dir, lead(bar_no) OVER w AS next_no, lead(close) OVER w AS next_close FROM y WHERE was = -s WINDOW w AS (PARTITION BY symbol, combo ORDER BY bar_no)), "
    + ladder_sql("n15m", MA_MOVES) + ", " + session_sql("n15m") + ", "
    "x2 AS (SELECT ev.*, eod_no, eod_close, sl, tp, CASE WHEN dir = 1 THEN [d0, d1][si] ELSE [u0, u1][si] END AS s_no, CASE WHEN dir = 1 THEN [u0, u1][ti] ELSE [d0, d1][ti] END AS t_no "
    "FROM ev JOIN ss USING (symbol, bar_no) JOIN ld USING (symbol, bar_no), (VALUES "
    + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {MA_MOVES.index(a) + 1}, {MA_MOVES.index(b) + 1})" for a, b in SW.MA_EXITS) + ") q(sl, tp, si, ti) WHERE NOT late AND NOT eod), "
    "x3 AS (SELECT *, least(s_no, t_no, next_no, eod_no) AS exit_no FROM x2), "
    "tr AS (SELECT x3.*, CASE WHEN s_no = exit_no THEN CASE WHEN dir = 1 THEN least(b.open, x3.close * (1 - sl)) ELSE greatest(b.open, x3.close * (1 + sl)) END "
    "WHEN t_no = exit_no THEN CASE WHEN dir = 1 THEN greatest(b.open, x3.close * (1 + tp)) ELSE least(b.open, x3.close * (1 - tp)) END "
    "WHEN next_no = exit_no THEN next_close ELSE eod_close END AS px FROM x3 JOIN n15m b ON b.symbol = x3.symbol AND b.bar_no = exit_no), "
    "nt AS (SELECT symbol, combo, sl, tp, fee, dir * (px / close - 1) - 2 * (fee + 0.0001) AS ret FROM tr, (SELECT unnest([0.001, 0.0025])::DOUBLE AS fee)), "
    "ms AS MATERIALIZED (SELECT symbol, ma_type, fast, slow, sl, tp, fee, count(*) AS n_trades, " + pf_sql() + " AS profit_factor, 100 * avg(ret) AS avg_trade_pct, "
    f"100.0 * count(*) FILTER (WHERE ret > 0) / count(*) AS win_rate_pct, {COMPOUND} AS total_return_pct FROM nt JOIN pr USING (combo) GROUP BY 1, 2, 3, 4, 5, 6, 7)"
)
MA_OUT = (
    f"symbol, ma_type, CAST(fast AS BIGINT) AS fast, CAST(slow AS BIGINT) AS slow, sl, tp, fee, n_trades, {rd('profit_factor')} AS profit_factor, {rd('avg_trade_pct')} AS avg_trade_pct, "
    f"{rd('win_rate_pct')} AS win_rate_pct, {rd('total_return_pct', 4)} AS total_return_pct"
)


def ma_stats(spark, sf):
    return SW.ma_sweep(numbered(spark, sf, "15min"), FEES)


def ma_shown(s):
    return s.select(
        "symbol", "ma_type", "fast", "slow", "sl", "tp", "fee", "n_trades",
        *[r(F.col(c)).alias(c) for c in ("profit_factor", "avg_trade_pct", "win_rate_pct")], r(F.col("total_return_pct"), 4).alias("total_return_pct"),
    )


@query("ma_sweep", sql("n15m", MA_SQL, f"SELECT {MA_OUT} FROM ms"))
def ma_sweep(spark, sf):
    """All pairs of 15 windows, simple and exponential, with four exits and both fees."""
    return ma_shown(ma_stats(spark, sf))


PLAT = (
    "wi AS (SELECT * FROM (VALUES " + ", ".join(f"({w}, {i})" for i, w in enumerate(SW.MA_WINDOWS)) + ") v(w, i)), "
    "pl AS MATERIALIZED (SELECT ms.*, f.i AS fi, s.i AS si FROM ms JOIN wi f ON f.w = fast JOIN wi s ON s.w = slow), "
    "nb AS (SELECT a.symbol, a.ma_type, a.sl, a.tp, a.fee, a.fast, a.slow, count(*) AS checked, count(*) FILTER (WHERE b.profit_factor > 1) AS good FROM pl a JOIN pl b "
    "ON a.symbol = b.symbol AND a.ma_type = b.ma_type AND a.sl = b.sl AND a.tp = b.tp AND a.fee = b.fee AND abs(a.fi - b.fi) + abs(a.si - b.si) = 1 AND b.profit_factor IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7)"
)


@query("plateau", sql("n15m", MA_SQL, PLAT,
       f"SELECT {MA_OUT} FROM pl JOIN nb USING (symbol, ma_type, sl, tp, fee, fast, slow) WHERE n_trades >= 30 AND good >= greatest(1, checked // 2) "
       "ORDER BY ms_pf DESC, symbol, ma_type, sl, tp, fee, fast, slow LIMIT 10".replace("ms_pf", "pl.profit_factor")))
def plateau(spark, sf):
    s = stage(ma_stats(spark, sf), "ma-stats")
    return ma_shown(GR.plateau(s, ["symbol", "ma_type", "sl", "tp", "fee"], SW.MA_WINDOWS))


MTF_EXEC = ["1h", "30min", "15min", "5min", "1min"]
_N = {"4h": "n4h", "2h": "n2h", "1h": "n1h", "30min": "n30m", "15min": "n15m", "5min": "n5m", "1min": "n1m"}


def stack_sql(name, tfs):
    rows = " UNION ALL ".join(f"SELECT '{tf}|' || symbol AS symbol, ts, bar_no, open, high, low, close, volume FROM {_N[tf]}" for tf in tfs)
    return f"{name} AS MATERIALIZED ({rows})"


K = "symbol, stf, dev, strict, adx"


def _hit(name, cond, price):
    return f"min(b.bar_no) FILTER ({cond}) AS {name}_no, arg_min({price}, b.bar_no) FILTER ({cond}) AS {name}_px"


def _level(name, level, gain):
    """First touch of a level: gains fill at the better of open and level, stops at the worse."""
    up, down = (("b.high >=", "greatest"), ("b.low <=", "least")) if gain else (("b.low <=", "least"), ("b.high >=", "greatest"))
    cond = f"CASE WHEN dir = 1 THEN {up[0]} {level} ELSE {down[0]} {level} END"
    price = f"CASE WHEN b.bar_no = entry_no THEN {level} WHEN dir = 1 THEN {up[1]}(b.open, {level}) ELSE {down[1]}(b.open, {level}) END"
    return _hit(name, cond, price)


def _band(name, dev):
    at = f"(b.mid + dir * {dev} * b.sd)"
    return _hit(name, f"CASE WHEN dir = 1 THEN b.high >= {at} ELSE b.low <= {at} END", f"least(greatest({at}, b.low), b.high)")


_FILL = [
    _level("s", "a.stop", False), _level("r1", "(price + dir * abs(price - a.stop))", True), _level("r2", "(price + dir * abs(price - a.stop) * 2)", True),
    *[_level(f"sl{i}", f"(price * (1 - dir * {m}::DOUBLE))", False) for i, m in enumerate(SW.LEVELS)],
    *[_level(f"tp{i}", f"(price * (1 + dir * {m}::DOUBLE))", True) for i, m in enumerate(SW.LEVELS)],
    _band("midband", "0"), _band("opposite", "dev"),
]
_TARGETS = " UNION ALL ".join(
    [f"SELECT id, '{t}' AS target, NULL::DOUBLE AS sl, NULL::DOUBLE AS tp, s_no AS n1, s_px AS p1, {t}_no AS n2, {t}_px AS p2, NULL AS n3, NULL::DOUBLE AS p3 FROM tc WHERE dev IS NOT NULL" for t in SW.TARGETS]
    + [f"SELECT id, NULL, {a}::DOUBLE, {b}::DOUBLE, sl{i}_no, sl{i}_px, tp{j}_no, tp{j}_px, raw_no, raw_px FROM tc WHERE dev IS NULL" for i, a in enumerate(SW.LEVELS) for j, b in enumerate(SW.LEVELS)]
)
MTF = (
    stack_sql("sk", GR.TF_PAIRS) + ", " + stack_sql("xk", MTF_EXEC) + ", "
    "pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {tf_seconds(a)})" for a, bs in GR.TF_PAIRS.items() for b in bs) + ") v(stf, etf, wide)), "
    f"fw AS MATERIALIZED (SELECT *, {full('avg(close)', 20)} AS mid, {full('stddev_pop(close)', 20)} AS sd FROM sk), "
    "ab AS (SELECT fw.*, dev, coalesce(close > mid + dev * sd, false) AS a, coalesce(close < mid - dev * sd, false) AS b FROM fw, (VALUES (2.0::DOUBLE), (2.5::DOUBLE)) q(dev)), "
    "e AS MATERIALIZED (SELECT *, " + ", ".join(
        f"coalesce(lag({c}, {k}) OVER (PARTITION BY symbol, dev ORDER BY bar_no), false) AS {c}{k}" for c in "ab" for k in (1, 2)
    ) + ", lag(low) OVER (PARTITION BY symbol, dev ORDER BY bar_no) AS pl, lag(high) OVER (PARTITION BY symbol, dev ORDER BY bar_no) AS ph FROM ab), "
    + AGU.replace("n1h", "sk").replace("2 PRECEDING AND CURRENT ROW) AS w", "1 PRECEDING AND CURRENT ROW) AS w") + ", " + ADX_OK.replace("n1h", "sk").replace("adx > 25", "adx > 32") + ", "
    "lv AS MATERIALIZED (SELECT symbol, bar_no, ts, 1 AS dir, high AS trigger FROM x6 WHERE a UNION ALL SELECT symbol, bar_no, ts, -1, low FROM x6 WHERE b), "
    "z AS (SELECT symbol, ts, dev, strict, NULL::BOOLEAN AS adx, 1 AS dir, high AS trigger, least(pl, low) AS stop FROM e, (VALUES (true), (false)) q(strict) WHERE b1 AND NOT b AND NOT (strict AND b2) UNION ALL "
    "SELECT symbol, ts, dev, strict, NULL, -1, low, greatest(ph, high) FROM e, (VALUES (true), (false)) q(strict) WHERE a1 AND NOT a AND NOT (strict AND a2) UNION ALL "
    "SELECT symbol, ts, NULL, NULL, false, dir, trigger, NULL FROM lv UNION ALL "
    "SELECT lv.symbol, lv.ts, NULL, NULL, true, dir, trigger, NULL FROM lv JOIN ok USING (symbol, bar_no) WHERE CASE WHEN dir = 1 THEN long_ok ELSE short_ok END), "
    "zx AS MATERIALIZED (SELECT etf || '|' || split_part(symbol, '|', 2) AS symbol, stf, dev, strict, adx, dir, trigger, stop, ts, ts + to_seconds(wide) AS seen, ts + to_seconds(3 * wide) AS exp_ts FROM z JOIN pr ON stf = split_part(symbol, '|', 1)), "
    "a1 AS (SELECT zx.*, b.bar_no AS act FROM zx ASOF JOIN xk b ON zx.symbol = b.symbol AND zx.seen <= b.ts), "
    "a2 AS (SELECT a1.*, b.bar_no AS last_live FROM a1 ASOF LEFT JOIN xk b ON a1.symbol = b.symbol AND a1.exp_ts > b.ts), "
    f"one AS (SELECT {K}, dir, act, max(ts) AS ts, arg_max(trigger, ts) AS trigger, arg_max(stop, ts) AS stop, arg_max(last_live, ts) AS last_live FROM a2 GROUP BY ALL), "
    f"lf AS (SELECT *, least(last_live, coalesce(lead(act) OVER (PARTITION BY {K}, dir ORDER BY act) - 1, last_live)) AS fin FROM one), "
    f"en AS (SELECT lf.symbol, stf, dev, strict, adx, dir, lf.ts AS signal_ts, any_value(stop) AS stop, min(b.bar_no) AS entry_no, min(b.ts) AS entry_ts, arg_min(CASE WHEN dir = 1 THEN greatest(b.open, trigger) ELSE least(b.open, trigger) END, b.bar_no) AS price "
    "FROM lf JOIN xk b ON b.symbol = lf.symbol AND b.bar_no BETWEEN act AND fin AND CASE WHEN dir = 1 THEN b.high > trigger ELSE b.low < trigger END GROUP BY ALL), "
    + session_sql("xk") + ", "
    "et AS MATERIALIZED (SELECT en.*, eod_no, eod_close, row_number() OVER () AS id FROM en JOIN ss ON ss.symbol = en.symbol AND ss.bar_no = entry_no WHERE NOT late AND NOT eod), "
    "ey AS MATERIALIZED (SELECT *, concat_ws('|', stf, coalesce(dev::VARCHAR, ''), coalesce(strict::VARCHAR, ''), coalesce(adx::VARCHAR, '')) AS k FROM et), "
    "fl AS (SELECT a.*, o.entry_no AS flip_no, o.price AS flip_px FROM ey a ASOF LEFT JOIN (SELECT symbol, k, -dir AS dir, entry_ts, entry_no, price FROM ey) o "
    "ON a.symbol = o.symbol AND a.k = o.k AND a.dir = o.dir AND a.entry_ts < o.entry_ts), "
    "rw AS (SELECT DISTINCT etf || '|' || split_part(lv.symbol, '|', 2) AS symbol, stf, -dir AS dir, lv.ts + to_seconds(wide) AS seen FROM lv JOIN pr ON stf = split_part(lv.symbol, '|', 1)), "
    "ra AS (SELECT DISTINCT rw.symbol, stf, dir, b.bar_no, b.ts, b.open FROM rw ASOF JOIN xk b ON rw.symbol = b.symbol AND rw.seen <= b.ts), "
    "fr AS MATERIALIZED (SELECT fl.*, ra.bar_no AS raw_no, ra.open AS raw_px FROM fl ASOF LEFT JOIN ra ON fl.symbol = ra.symbol AND fl.stf = ra.stf AND fl.dir = ra.dir AND fl.entry_ts < ra.ts), "
    "sw AS (SELECT etf || '|' || split_part(symbol, '|', 2) AS symbol, stf, ts + to_seconds(wide) AS seen, mid, sd FROM fw JOIN pr ON stf = split_part(symbol, '|', 1)), "
    "xs AS (SELECT xk.*, stf FROM xk JOIN pr ON etf = split_part(symbol, '|', 1)), "
    "bx AS MATERIALIZED (SELECT xs.*, sw.mid, sw.sd FROM xs ASOF LEFT JOIN sw ON xs.symbol = sw.symbol AND xs.stf = sw.stf AND xs.ts >= sw.seen), "
    "th AS (SELECT id, " + ", ".join(_FILL) + " FROM fr a JOIN bx b ON b.symbol = a.symbol AND b.stf = a.stf AND b.bar_no BETWEEN entry_no AND eod_no GROUP BY id), "
    "tc AS MATERIALIZED (SELECT * FROM fr JOIN th USING (id)), "
    f"ex AS MATERIALIZED (SELECT {K}, dir, entry_ts, entry_no, price, k || coalesce(target, '') || coalesce(sl::VARCHAR || tp::VARCHAR, '') AS kk, target, sl, tp, least(n1, n2, n3, flip_no, eod_no) AS exit_no, "
    "CASE least(n1, n2, n3, flip_no, eod_no) WHEN n1 THEN p1 WHEN n2 THEN p2 WHEN n3 THEN p3 WHEN flip_no THEN flip_px ELSE eod_close END AS px FROM (" + _TARGETS + ") JOIN tc USING (id)), "
    "tr AS MATERIALIZED (SELECT ex.*, b.ts AS exit_ts, row_number() OVER (PARTITION BY ex.symbol, kk ORDER BY entry_ts, b.ts, dir) AS no FROM ex JOIN xk b ON b.symbol = ex.symbol AND b.bar_no = exit_no), "
    "fs AS (SELECT symbol, kk, entry_ts, min(no) AS no FROM tr GROUP BY ALL), "
    "lk AS MATERIALIZED (SELECT a.symbol, a.kk, a.no, CASE WHEN b.no IS NOT NULL THEN greatest(b.no, a.no + 1) END AS nxt FROM tr a ASOF LEFT JOIN fs b ON a.symbol = b.symbol AND a.kk = b.kk AND a.exit_ts <= b.entry_ts), "
    "ch AS (SELECT symbol, kk, no, nxt FROM lk WHERE no = 1 UNION ALL SELECT lk.symbol, lk.kk, lk.no, lk.nxt FROM ch JOIN lk ON lk.symbol = ch.symbol AND lk.kk = ch.kk AND lk.no = ch.nxt WHERE ch.nxt IS NOT NULL), "
    "f AS (SELECT split_part(symbol, '|', 2) AS symbol, CASE WHEN dev IS NULL THEN 'didi' ELSE 'fffd' END AS strategy, stf AS setup_tf, split_part(symbol, '|', 1) AS exec_tf, dev, strict, adx AS adx_filter, target, sl, tp, fee, "
    "dir * (px / price - 1) - 2 * (fee + 0.0001) AS ret FROM tr JOIN ch USING (symbol, kk, no), (SELECT unnest([0.001, 0.0025])::DOUBLE AS fee))"
)
MTF_KEYS = "symbol, strategy, setup_tf, exec_tf, dev, strict, adx_filter, target, sl, tp, fee"


@query("mtf_sweep", sql("n4h n2h n1h n30m n15m n5m n1m", MTF, f"SELECT {MTF_KEYS}, {GROUP_COLS} FROM f GROUP BY {MTF_KEYS}", recursive=True))
def mtf_sweep(spark, sf):
    """All 19 timeframe pairs, both families, four targets or four exits, both fees."""
    frames = {tf: numbered(spark, sf, tf) for tf in {*GR.TF_PAIRS, *MTF_EXEC}}
    t = SW.mtf_sweep({tf: frames[tf] for tf in GR.TF_PAIRS}, {tf: frames[tf] for tf in MTF_EXEC}, FEES)
    return t.groupBy(*MTF_KEYS.split(", ")).agg(*group_columns())


@query(
    "variant_compare",
    sql("n1h n4h", ENT, PCT,
        rsi_cte("r4", "n4h", 14)
        + ", rt AS MATERIALIZED (SELECT tr.*, rsi FROM tr ASOF LEFT JOIN (SELECT *, ts + INTERVAL 4 HOUR AS seen FROM r4) a ON tr.symbol = a.symbol AND tr.entry_ts >= a.seen WHERE exit_ts IS NOT NULL), "
        "u AS (SELECT 'base' AS variant, ret FROM rt UNION ALL SELECT 'rsi_35', ret FROM rt WHERE CASE WHEN dir = 1 THEN rsi >= 45 ELSE rsi <= 55 END), "
        "f AS (SELECT variant, fee, ret - 2 * (fee + 0.0001) AS ret FROM u, (VALUES (0.00035::DOUBLE), (0.000875::DOUBLE)) q(fee))",
        f"SELECT variant, fee, {GROUP_COLS} FROM f GROUP BY 1, 2"),
)
def variant_compare(spark, sf):
    """A filter against the unfiltered baseline, at both fees."""
    t, n = pct_trades(spark, sf)
    closed = t.where(F.col("exit_ts").isNotNull())
    ok = G.rsi(n, {"4h": numbered(spark, sf, "4h")}, "4h", 14, (45, 100), (0, 55)).select(
        "symbol", F.col("bar_no").alias("entry_no"), "long_ok", "short_ok"
    )
    passed = F.when(F.col("dir") == 1, F.col("long_ok")).otherwise(F.col("short_ok"))
    variants = F.array_compact(F.array(F.lit("base"), F.when(passed, F.lit("rsi_35"))))
    each = closed.join(ok, ["symbol", "entry_no"]).withColumn("variant", F.explode(variants)).withColumn(
        "fee", F.explode(F.array(F.lit(0.00035), F.lit(0.000875)))
    )
    return each.withColumn("ret", O.net_return(F.col("ret"), F.col("fee"))).groupBy("variant", "fee").agg(*group_columns())


TRAIL_D = [0.2, 0.4, 0.6]


@query(
    "trail_sweep",
    sql("n1h", ENT,
        "e2 AS (SELECT ent.*, d FROM ent, (VALUES " + ", ".join(f"({d}::DOUBLE)" for d in TRAIL_D) + ") q(d)), "
        "wk AS (SELECT e2.*, b.bar_no, b.open, b.high, b.low, b.close, CASE WHEN dir = 1 THEN greatest(price, max(b.high) OVER w) ELSE least(price, min(b.low) OVER w) END AS peak "
        "FROM e2 JOIN n1h b ON b.symbol = e2.symbol AND b.bar_no BETWEEN entry_no + 1 AND entry_no + 24 "
        "WINDOW w AS (PARTITION BY e2.symbol, entry_no, dir, d ORDER BY b.bar_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
        "w2 AS (SELECT *, peak * (1 - dir * d) AS lvl FROM wk), w3 AS (SELECT *, CASE WHEN dir = 1 THEN low <= lvl ELSE high >= lvl END AS hit FROM w2), "
        "ex AS (SELECT symbol, entry_no, dir, d, any_value(price) AS price, arg_min(CASE WHEN hit THEN CASE WHEN dir = 1 THEN least(open, lvl) ELSE greatest(open, lvl) END ELSE close END, bar_no) AS px "
        "FROM w3 WHERE hit OR bar_no = entry_no + 24 GROUP BY 1, 2, 3, 4), "
        "f AS (SELECT d, dir * (px / price - 1) AS ret FROM ex)",
        f"SELECT d AS distance, {GROUP_COLS} FROM f GROUP BY 1"),
)
def trail_sweep(spark, sf):
    n = numbered(spark, sf, "1h")
    each = next_bar_entries(n).withColumn("distance", F.explode(F.array(*[F.lit(d) for d in TRAIL_D])))
    t = O.trailing_outcomes(each, n, F.col("distance"), 24, ids=["symbol", "entry_no", "dir", "distance"])
    return t.where(F.col("ret").isNotNull()).groupBy("distance").agg(*group_columns())


# ---------------------------------------------------------------- walk-forward

FOLDS = (
    "sp AS (SELECT {k}, min(entry_ts) AS t0, max(entry_ts) AS t1 FROM trades GROUP BY 1), "
    "fo AS MATERIALIZED (SELECT {k}, f AS fold, t0 + INTERVAL 30 DAY * f AS train_start, t0 + INTERVAL 30 DAY * f + INTERVAL 120 DAY AS train_end, "
    "t0 + INTERVAL 30 DAY * f + INTERVAL 150 DAY AS test_end FROM sp, (SELECT CAST(unnest(range(0, (SELECT CAST(max(date_diff('day', t0, t1)) // 30 + 1 AS BIGINT) FROM sp))) AS INTEGER) AS f) "
    "WHERE t0 + INTERVAL 30 DAY * f + INTERVAL 150 DAY <= t1 + INTERVAL 1 DAY)"
)
FOLD_STATS = (
    "fs AS MATERIALIZED (SELECT fo.symbol, fold, cfg, count(*) FILTER (WHERE entry_ts < train_end) AS train_n, "
    f"{pf_sql('CASE WHEN entry_ts < train_end THEN ret END', 'inf_or_zero')} AS train_pf, avg(CASE WHEN entry_ts < train_end THEN ret END) AS train_mean, "
    f"count(*) FILTER (WHERE entry_ts >= train_end) AS test_n, {pf_sql('CASE WHEN entry_ts >= train_end THEN ret END', 'inf_or_zero')} AS test_pf "
    "FROM fo JOIN trades t ON t.symbol = fo.symbol AND entry_ts >= train_start AND entry_ts < test_end GROUP BY 1, 2, 3), "
    "wn AS MATERIALIZED (SELECT symbol, fold, cfg AS winner, train_n, train_pf, test_n, test_pf FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold "
    "ORDER BY round(train_pf, 9) DESC, round(train_mean, 9) DESC, cfg) AS rn FROM fs WHERE train_n >= 4) WHERE rn = 1)"
)
OOS = (
    "oo AS MATERIALIZED (SELECT t.*, fo.fold FROM trades t JOIN fo ON t.symbol = fo.symbol AND entry_ts >= train_end AND entry_ts < test_end "
    "JOIN wn ON wn.symbol = fo.symbol AND wn.fold = fo.fold AND wn.winner = t.cfg)"
)
OOS_COLS = (
    f"count(*) AS oos_trades, {rd(pf_sql(), 3)} AS oos_pf, {rd('100.0 * count(*) FILTER (WHERE ret > 0) / count(*)', 1)} AS oos_win_rate_pct, "
    f"{rd('100 * avg(ret)', 3)} AS oos_avg_trade_pct, {rd(COMPOUND, 2)} AS oos_return_pct"
)
WF = [FOLDS.format(k="symbol"), FOLD_STATS]
KEY = ["symbol"]


def wf_parts(spark, sf):
    t = trades(spark, sf)
    return t, stage(V.select_winners(V.fold_stats(t, KEY, "cfg"), KEY, "cfg", 4), "winners")


@query("make_folds", sql("trades", FOLDS.format(k="symbol"), "SELECT symbol, CAST(fold AS BIGINT) AS fold, train_start, train_end, test_end FROM fo"))
def make_folds(spark, sf):
    f = V.make_folds(trades(spark, sf), KEY)
    return f.select("symbol", "fold", *[ntz(F.col(c)).alias(c) for c in ("train_start", "train_end", "test_end")])


@query("fold_trades", sql("trades", FOLDS.format(k="symbol"),
       "SELECT fo.symbol, CAST(fold AS BIGINT) AS fold, CASE WHEN entry_ts < train_end THEN 'train' ELSE 'test' END AS role, count(*) AS n, "
       f"{rd('sum(ret)')} AS ret FROM fo JOIN trades t ON t.symbol = fo.symbol AND entry_ts >= train_start AND entry_ts < test_end GROUP BY 1, 2, 3"))
def fold_trades(spark, sf):
    p = V.fold_trades(trades(spark, sf), KEY)
    return p.groupBy("symbol", "fold", "role").agg(F.count(F.lit(1)).alias("n"), r(F.sum("ret")).alias("ret"))


@query("wf_select", sql("trades", *WF, f"SELECT symbol, CAST(fold AS BIGINT) AS fold, winner, train_n, {rd('train_pf')} AS train_pf, test_n, {rd('test_pf')} AS test_pf FROM wn"))
def wf_select(spark, sf):
    _, w = wf_parts(spark, sf)
    return w.select("symbol", "fold", "winner", "train_n", r(F.col("train_pf")).alias("train_pf"), "test_n", r(F.col("test_pf")).alias("test_pf"))


@query("wf_summary", sql("trades", *WF,
       "SELECT symbol, count(*) AS folds_total, count(winner) AS folds_with_winner, count(DISTINCT winner) AS distinct_winners FROM fo LEFT JOIN wn USING (symbol, fold) GROUP BY 1"))
def wf_summary(spark, sf):
    t, w = wf_parts(spark, sf)
    won = w.groupBy("symbol", "winner").agg(F.count(F.lit(1)).alias("n")).groupBy("symbol").agg(
        F.sum("n").alias("folds_with_winner"), F.count(F.lit(1)).alias("distinct_winners")
    )
    total = V.spans(t, KEY).where("n_folds > 0").select("symbol", F.col("n_folds").alias("folds_total"))
    zero = F.lit(0).cast("long")
    return total.join(won, "symbol", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("folds_with_winner", "distinct_winners")}
    )


@query("wf_portfolio", sql("trades", *WF, OOS,
       f"SELECT 'ALL' AS symbol, {OOS_COLS} FROM oo UNION ALL SELECT CAST(symbol AS VARCHAR), {OOS_COLS} FROM oo GROUP BY symbol"))
def wf_portfolio(spark, sf):
    """Out-of-sample record per symbol and pooled over all of them."""
    t, w = wf_parts(spark, sf)
    oos = V.stitched(t, w, KEY, "cfg").withColumn("symbol", F.col("symbol").cast("string"))
    g = oos.groupingSets([[], ["symbol"]], "symbol").agg(*oos_columns(F.col("ret")))
    return g.withColumn("symbol", F.coalesce("symbol", F.lit("ALL")))


@query("wf_variants", sql("trades", *WF, OOS,
       "fx AS (SELECT t.* FROM trades t JOIN fo ON t.symbol = fo.symbol AND entry_ts >= train_end AND entry_ts < test_end)",
       f"SELECT 'adaptive' AS variant, {OOS_COLS} FROM oo UNION ALL SELECT cfg, {OOS_COLS} FROM fx GROUP BY cfg"))
def wf_variants(spark, sf):
    """Each variant held fixed against picking one per fold."""
    t, w = wf_parts(spark, sf)
    ret = F.col("ret")
    adaptive = V.stitched(t, w, KEY, "cfg").groupBy(F.lit("adaptive").alias("variant")).agg(*oos_columns(ret))
    fixed = V.tested_trades(t, KEY).groupBy(F.col("cfg").alias("variant")).agg(*oos_columns(ret))
    return adaptive.unionByName(fixed)


@query("oos_aggregate", sql("trades", *WF, OOS, f"SELECT symbol, {OOS_COLS} FROM oo GROUP BY symbol"))
def oos_aggregate(spark, sf):
    """Out-of-sample record of each symbol: the trades of its folds' winners in their test windows."""
    t, w = wf_parts(spark, sf)
    return V.stitched(t, w, KEY, "cfg").groupBy("symbol").agg(*oos_columns(F.col("ret")))


@query("oos_verdict", sql("trades", *WF, OOS, f"SELECT symbol, {rd('max(pf)')} AS best_oos_pf, max(round(pf, 9)) > 1 AS enabled FROM "
       f"(SELECT symbol, fee > 0.04 AS high_fee, {pf_sql()} AS pf FROM oo GROUP BY 1, 2) WHERE NOT high_fee GROUP BY 1"))
def oos_verdict(spark, sf):
    """Best out-of-sample factor of the first fee scenario decides whether a symbol stays on."""
    t, w = wf_parts(spark, sf)
    oos = V.stitched(t, w, KEY, "cfg").withColumn("high_fee", F.col("fee") > 0.04)
    pf = oos.groupBy("symbol", "high_fee").agg(M.profit_factor(F.col("ret")).alias("pf")).where(~F.col("high_fee"))
    return pf.groupBy("symbol").agg(r(F.max("pf")).alias("best_oos_pf"), (F.max(F.round("pf", 9)) > 1).alias("enabled"))


@query("oos_period", sql("trades", *WF, OOS,
       f"SELECT symbol, count(*) AS n, {rd(COMPOUND)} AS period_pct FROM oo WHERE entry_ts >= (SELECT max(date_trunc('day', entry_ts)) FROM oo) - INTERVAL 365 DAY GROUP BY 1"))
def oos_period(spark, sf):
    """Result of the last year of the out-of-sample curve, measured from the newest day of all symbols."""
    t, w = wf_parts(spark, sf)
    oos = stage(V.stitched(t, w, KEY, "cfg").select("symbol", "entry_ts", "ret"), "oos")
    last = oos.agg(F.max(floor_ts(F.col("entry_ts"), DAY))).scalar()
    recent = oos.where(F.col("entry_ts") >= add_tf(last, "1d", -365))
    return recent.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(M.compounded_pct(F.col("ret"))).alias("period_pct"))


@query("latest_winner", sql("trades", *WF, "SELECT s_suppkey AS symbol, CASE WHEN s_suppkey % 10 = 0 THEN 'explicit' ELSE arg_max(winner, fold) END AS cfg "
       "FROM supplier LEFT JOIN wn ON wn.symbol = s_suppkey GROUP BY 1"))
def latest_winner(spark, sf):
    _, w = wf_parts(spark, sf)
    last = w.groupBy("symbol").agg(F.max_by("winner", "fold").alias("winner"))
    roster = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("symbol"), F.when(F.col("s_suppkey") % 10 == 0, "explicit").alias("explicit")
    )
    return roster.join(last, "symbol", "left").select("symbol", F.coalesce("explicit", "winner").alias("cfg"))


@query(
    "best_curve",
    sql("trades",
        f"st AS (SELECT symbol, cfg, count(*) AS n, {pf_sql(no_loss='inf_or_zero')} AS pf FROM trades GROUP BY 1, 2), "
        "bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n >= 100 DESC, round(pf, 9) DESC, cfg) AS rn FROM st WHERE n >= 10) WHERE rn = 1), "
        f"dl AS (SELECT symbol, cfg, date_trunc('day', entry_ts) AS day, {GROWTH} FROM trades JOIN bs USING (symbol, cfg) GROUP BY 1, 2, 3)",
        f"SELECT symbol, cfg, day, {rd('CASE WHEN sum(lost) OVER (PARTITION BY symbol ORDER BY day) = 0 THEN sum(lr) OVER (PARTITION BY symbol ORDER BY day) END')} AS log_equity FROM dl"),
)
def best_curve(spark, sf):
    """Equity of each symbol's best setup; setups with enough trades go first."""
    t = trades(spark, sf)
    st = t.groupBy("symbol", "cfg").agg(
        F.count(F.lit(1)).alias("n"), F.round(M.profit_factor(F.col("ret"), "inf_or_zero"), 9).alias("pf")
    )
    best = best_per(st.where("n >= 10"), ["symbol"], [F.desc(F.col("n") >= 100), F.desc("pf"), F.col("cfg")])
    day = (
        t.join(best.select("symbol", "cfg"), ["symbol", "cfg"], "left_semi")
        .groupBy("symbol", "cfg", floor_ts(F.col("entry_ts"), DAY).alias("day"))
        .agg(F.sum(M.log_growth(F.col("ret"))).alias("lr"), F.sum(M.ruined(F.col("ret"))).alias("lost"))
    )
    from tapeloom.operators.series import prefix_scan, time_bucket

    run = prefix_scan(
        day, ["symbol"], ["day"], time_bucket("day", 90 * DAY), {"log_equity": ("sum", F.col("lr")), "gone": ("sum", F.col("lost"))}
    )
    equity = F.when(F.col("gone") == 0, F.col("log_equity"))
    return run.select("symbol", "cfg", ntz(F.col("day")).alias("day"), r(equity).alias("log_equity"))


# ---------------------------------------------------------------- league

LEAGUE = (
    "lg AS MATERIALIZED (SELECT *, cfg || '|' || {s} AS sig, CASE WHEN symbol % 4 = 0 THEN 'crypto' ELSE 'stock' END AS cls, "
    "ret * CASE WHEN symbol % 4 = 0 THEN 100 ELSE 1000 END AS usd FROM trades), "
    "cu AS (SELECT max(entry_ts) - INTERVAL 360 DAY AS cut FROM trades), "
    "pa AS MATERIALIZED (SELECT sig, symbol, cls, count(*) FILTER (WHERE entry_ts >= cut) AS hn, "
    f"{pf_sql('CASE WHEN entry_ts >= cut THEN usd END', 'inf_or_null')} AS hpf FROM lg, cu GROUP BY 1, 2, 3)"
)


def league_sql(where: str, cls: str) -> str:
    """Statistics of one class straight from the trades."""
    on_t, on_h = "CASE WHEN entry_ts < cut THEN usd END", "CASE WHEN entry_ts >= cut THEN usd END"
    sh = lambda x: f"round(avg({x}) / nullif(stddev_samp({x}), 0), 3)"
    need = {"all": 5, "stock": 5, "crypto": 3}[cls]
    return (
        f"SELECT sig, '{cls}' AS asset_class, count({on_t}) AS train_trades, {pf_sql(on_t, 'inf_or_null')} AS train_pf, coalesce(sum({on_t}), 0) AS train_pnl_usd, {sh(on_t)} AS train_sharpe, "
        f"count({on_h}) AS hold_trades, {pf_sql(on_h, 'inf_or_null')} AS hold_pf, coalesce(sum({on_h}), 0) AS hold_pnl_usd, {sh(on_h)} AS hold_sharpe, "
        f"any_value(assets_logged) AS assets_logged, any_value(hold_assets) AS hold_assets, any_value(hold_good) AS hold_assets_pf_gt1, "
        f"count({on_h}) >= {{m}} AND any_value(hold_assets) >= {need} AS eligible "
        f"FROM lg, cu JOIN (SELECT sig, count(*) AS assets_logged, count(*) FILTER (WHERE hn >= 3) AS hold_assets, count(*) FILTER (WHERE hn >= 3 AND hpf > 1) AS hold_good "
        f"FROM pa {where} GROUP BY 1) a USING (sig) {where} GROUP BY 1"
    ).replace("FROM lg, cu JOIN", "FROM lg CROSS JOIN cu JOIN")


def lstats(m: int) -> str:
    parts = [league_sql("", "all"), league_sql("WHERE cls = 'stock'", "stock"), league_sql("WHERE cls = 'crypto'", "crypto")]
    return "ls AS MATERIALIZED (" + " UNION ALL ".join(p.replace("{m}", str(m)) for p in parts) + ")"


LS_OUT = (
    "sig, asset_class, assets_logged, train_trades, " + f"{rd('train_pf')} AS train_pf, {rd('train_pnl_usd', 2)} AS train_pnl_usd, {rd('train_sharpe', 3)} AS train_sharpe, "
    f"hold_trades, {rd('hold_pf')} AS hold_pf, {rd('hold_pnl_usd', 2)} AS hold_pnl_usd, {rd('hold_sharpe', 3)} AS hold_sharpe, hold_assets, hold_assets_pf_gt1, eligible"
)
FINE = "(part_id % 200)"


def league_trades(spark, sf, fine: bool = False):
    tail = F.pmod("part_id", F.lit(200)) if fine else F.col("line_no")
    return trades(spark, sf).withColumns(
        {
            "sig": F.concat_ws("|", "cfg", tail.cast("string")),
            "asset_class": F.when(F.col("symbol") % 4 == 0, "crypto").otherwise("stock"),
            "usd": F.col("ret") * F.when(F.col("symbol") % 4 == 0, 100).otherwise(1000),
        }
    )


def league_rows(spark, sf, fine: bool = False, min_hold: int = 30):
    t = league_trades(spark, sf, fine)
    return L.roll_up(L.per_asset(t, L.cutoff(t, 360)), min_hold)


def ls_shown(s):
    return s.withColumns(
        {
            "train_pf": r(F.col("train_pf")), "hold_pf": r(F.col("hold_pf")),
            "train_pnl_usd": r(F.col("train_pnl_usd"), 2), "hold_pnl_usd": r(F.col("hold_pnl_usd"), 2),
            "train_sharpe": r(F.col("train_sharpe"), 3), "hold_sharpe": r(F.col("hold_sharpe"), 3),
        }
    )


@query("league_stats", sql("trades", LEAGUE.format(s="line_no"), lstats(30), f"SELECT {LS_OUT} FROM ls WHERE asset_class = 'all'"))
def league_stats(spark, sf):
    return ls_shown(league_rows(spark, sf)).where("asset_class = 'all'")


@query("league_rollup", sql("trades", LEAGUE.format(s="line_no"), lstats(30), f"SELECT {LS_OUT} FROM ls"))
def league_rollup(spark, sf):
    return ls_shown(league_rows(spark, sf))


SEEN = "se AS (SELECT sig, min(entry_ts) + INTERVAL 1500 DAY AS first_seen FROM lg GROUP BY 1)"


@query("post_discovery", sql("trades", LEAGUE.format(s="line_no"), SEEN,
       f"SELECT sig, count(usd) AS post_trades, {rd(pf_sql('usd', 'inf_or_null'))} AS post_pf, {rd('coalesce(sum(usd), 0)', 2)} AS post_pnl_usd "
       "FROM se LEFT JOIN lg USING (sig) WHERE entry_ts >= first_seen GROUP BY 1"))
def post_discovery(spark, sf):
    t = league_trades(spark, sf)
    seen = t.groupBy("sig").agg(add_tf(F.min("entry_ts"), "1d", 1500).alias("first_seen"))
    p = L.post_discovery(t, seen)
    return p.select("sig", "post_trades", r(F.col("post_pf")).alias("post_pf"), r(F.col("post_pnl_usd"), 2).alias("post_pnl_usd"))


OLD = (
    "od AS (SELECT sig, min(entry_ts) AS first_seen, CAST(2 AS BIGINT) AS rounds_tested, CAST(0.5 AS DOUBLE) AS hold_pf FROM lg WHERE entry_ts < TIMESTAMP '1998-06-01' GROUP BY 1), "
    "nw AS (SELECT sig, " + pf_sql("usd", "inf_or_null") + " AS hold_pf FROM lg WHERE entry_ts >= TIMESTAMP '1998-06-01' GROUP BY 1)"
)


@query("league_merge", sql("trades", LEAGUE.format(s=FINE), OLD,
       "SELECT coalesce(od.sig, nw.sig) AS sig, coalesce(first_seen, TIMESTAMP '2024-01-01') AS first_seen, CAST(coalesce(rounds_tested, 0) + CASE WHEN nw.sig IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS rounds_tested, "
       f"{rd('CASE WHEN nw.sig IS NOT NULL THEN nw.hold_pf ELSE od.hold_pf END')} AS hold_pf FROM od FULL JOIN nw ON od.sig = nw.sig"))
def league_merge(spark, sf):
    t = league_trades(spark, sf, fine=True)
    old = t.where("entry_ts < timestamp '1998-06-01'").groupBy("sig").agg(
        F.min("entry_ts").alias("first_seen"), F.lit(2).cast("long").alias("rounds_tested"), F.lit(0.5).alias("hold_pf")
    )
    new = t.where("entry_ts >= timestamp '1998-06-01'").groupBy("sig").agg(M.profit_factor(F.col("usd"), "inf_or_null").alias("hold_pf"))
    m = L.merge_store(old, new, F.lit("2024-01-01").cast("timestamp"))
    return m.select("sig", ntz(F.col("first_seen")).alias("first_seen"), "rounds_tested", r(F.col("hold_pf")).alias("hold_pf"))


RANK = (
    "rk AS MATERIALIZED (SELECT sig, asset_class, row_number() OVER (PARTITION BY asset_class ORDER BY round(hold_pf, 9) DESC, sig) AS rank FROM ls WHERE eligible AND hold_pf < 1e308)"
)


@query("league_rank", sql("trades", LEAGUE.format(s=FINE), lstats(5), RANK,
       f"SELECT ls.sig, ls.asset_class, {rd('hold_pf')} AS hold_pf, eligible, rank FROM ls LEFT JOIN rk USING (sig, asset_class)"))
def league_rank(spark, sf):
    s = stage(league_rows(spark, sf, fine=True, min_hold=5).select("sig", "asset_class", "hold_pf", "eligible"), "league")
    return L.ranked(s).select("sig", "asset_class", r(F.col("hold_pf")).alias("hold_pf"), "eligible", "rank")


@query("prune_anti", sql("trades", LEAGUE.format(s="line_no"), lstats(30), RANK,
       "kp AS (SELECT sig FROM rk WHERE rank <= 5 UNION SELECT 'AF|1')",
       "SELECT DISTINCT sig, symbol FROM lg WHERE sig NOT IN (SELECT sig FROM kp)"))
def prune_anti(spark, sf):
    """Registry rows to delete once only the leaders and favourites are kept."""
    s = stage(league_rows(spark, sf).select("sig", "asset_class", "hold_pf", "eligible"), "league")
    t = league_trades(spark, sf)
    fav = t.where("sig = 'AF|1'").select("sig").distinct()
    return L.prune(t.select("sig", "symbol").distinct(), L.keepers(s, fav, 5)).select("sig", "symbol")


@query("new_leader", sql("trades", LEAGUE.format(s="line_no"), lstats(30),
       "kn AS (SELECT DISTINCT sig FROM lg WHERE cfg NOT IN ('RF', 'RO')), el AS (SELECT sig, round(hold_pf, 9) AS pf FROM ls WHERE asset_class = 'all' AND eligible AND hold_pf < 1e308), "
       "bb AS (SELECT max(pf) AS m FROM el WHERE sig IN (SELECT sig FROM kn))",
       f"SELECT sig, {rd('pf')} AS hold_pf, pf > greatest(m, 1.1) AS is_leader FROM el, bb WHERE sig NOT IN (SELECT sig FROM kn) ORDER BY pf DESC, sig DESC LIMIT 1"))
def new_leader(spark, sf):
    s = stage(league_rows(spark, sf).where("asset_class = 'all'").select("sig", "hold_pf", "eligible"), "league")
    seen = league_trades(spark, sf).where("cfg not in ('RF', 'RO')").select("sig").distinct()
    return L.new_leader(s, seen).withColumn("hold_pf", r(F.col("hold_pf")))


@query("league_archive", sql("trades", LEAGUE.format(s=FINE), lstats(5), f"SELECT sig, {rd('hold_pf')} AS hold_pf, hold_trades FROM ls WHERE asset_class = 'all' AND (round(hold_pf, 9) < 0.9 OR hold_trades = 0)"))
def league_archive(spark, sf):
    s = league_rows(spark, sf, fine=True).where("asset_class = 'all'")
    gone = s.where((F.round("hold_pf", 9) < 0.9) | (F.col("hold_trades") == 0))
    return gone.select("sig", r(F.col("hold_pf")).alias("hold_pf"), "hold_trades")


# ---------------------------------------------------------------- exploration and robustness

KINDS = ["ma_cross", "donchian", "boll", "macd", "mom", "vwap", "orb", "rsi_cross", "fffd_ff"]
LCG = "(1103515245 * ({x} + 12345) + 12345) % 2147483648"


@query(
    "explore_sample",
    sql("runs",
        "sd AS (SELECT c_custkey AS id, " + LCG.format(x="c_custkey") + " AS h1 FROM customer), s2 AS (SELECT *, " + LCG.format(x="h1") + " AS h2 FROM sd), s3 AS (SELECT *, " + LCG.format(x="h2") + " AS h3 FROM s2), "
        "cd AS (SELECT id, ['" + "', '".join(KINDS) + "'][(h1 // 65536) % 9 + 1] AS kind, ['4h', '2h', '1h', '30min'][(h2 // 65536) % 4 + 1] AS setup_tf, (h3 // 65536) % 100 AS gate_roll FROM s3), "
        "c2 AS (SELECT id, kind || '|' || setup_tf || '|' || CASE WHEN gate_roll < CASE WHEN kind IN ('ma_cross', 'donchian', 'macd', 'mom', 'orb') THEN 80 ELSE 25 END THEN 'gated' ELSE 'open' END AS sig FROM cd), "
        "tr AS (SELECT DISTINCT ['" + "', '".join(KINDS) + "'][symbol % 9 + 1] || '|1h|open' AS sig FROM runs WHERE strategy = 'F')",
        "SELECT sig, count(*) AS draws FROM c2 WHERE sig NOT IN (SELECT sig FROM tr) GROUP BY 1"),
)
def explore_sample(spark, sf):
    """Random configurations from option lists, one draw per customer seed, minus those already tried."""
    def lcg(x):
        return F.pmod(F.lit(1103515245).cast("long") * (x + 12345) + 12345, F.lit(2147483648))

    def pick(options, h):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.floor(h / F.lit(65536)), F.lit(len(options))) + 1).cast("int"))

    seeds = table(spark, sf, "customer").select(lcg(F.col("c_custkey")).alias("h1"))
    drawn = seeds.withColumn("h2", lcg(F.col("h1"))).withColumn("h3", lcg(F.col("h2")))
    directional = ["ma_cross", "donchian", "macd", "mom", "orb"]
    kind = pick(KINDS, F.col("h1"))
    roll = F.pmod(F.floor(F.col("h3") / F.lit(65536)), F.lit(100))
    gate = F.when(roll < F.when(kind.isin(directional), 80).otherwise(25), "gated").otherwise("open")
    cand = drawn.select(F.concat_ws("|", kind, pick(["4h", "2h", "1h", "30min"], F.col("h2")), gate).alias("sig"))
    tried = runs(spark, sf).where("strategy = 'F'").select(
        F.concat_ws("|", F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("symbol") % 9 + 1).cast("int")), F.lit("1h"), F.lit("open")).alias("sig")
    ).distinct()
    return cand.join(tried, "sig", "left_anti").groupBy("sig").agg(F.count(F.lit(1)).alias("draws"))


#: simulated paths, and the multiple of a trade's own fee that the stressed result pays
SIMS, STRESS = 2000, 2.5
BOOT = (
    DAYPNL
    + ", dn AS MATERIALIZED (SELECT cfg, pnl, row_number() OVER (PARTITION BY cfg ORDER BY day) - 1 AS d, count(*) OVER (PARTITION BY cfg) AS n FROM dp), "
    "cn AS (SELECT cfg, any_value(n) AS n FROM dn GROUP BY 1 HAVING any_value(n) >= 10), "
    f"st AS (SELECT cfg, n, sim, slot, (1103515245 * (sim * 1000003 + slot * 7919 + 12345) + 12345) % 2147483648 % n AS s FROM cn, (SELECT unnest(range(0, {SIMS})) AS sim), "
    "(SELECT unnest(range(0, (SELECT max(n) // 5 + 40 FROM cn))) AS slot) WHERE slot < n // 5 + 40), "
    "ln AS MATERIALIZED (SELECT *, least(5, n - s) AS len, coalesce(sum(least(5, n - s)) OVER (PARTITION BY cfg, sim ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM st), "
    "lk AS MATERIALIZED (SELECT cfg, sim, o + k AS pos, s + k AS d FROM ln CROSS JOIN (SELECT unnest(range(0, 5)) AS k) WHERE k < len AND o + k < n), "
    "sq AS MATERIALIZED (SELECT cfg, sim, pos, pnl FROM lk JOIN dn USING (cfg, d)), "
    "cm AS (SELECT *, sum(pnl) OVER (PARTITION BY cfg, sim ORDER BY pos) AS c FROM sq), "
    "pk AS (SELECT *, greatest(0, max(c) OVER (PARTITION BY cfg, sim ORDER BY pos)) AS p FROM cm), "
    "pt AS MATERIALIZED (SELECT cfg, sim, sum(pnl) AS total, least(0, min(c - p)) AS dd FROM pk GROUP BY 1, 2)"
)
QS = [("total", "p05_total", 0.05), ("total", "p50_total", 0.5), ("total", "p95_total", 0.95), ("dd", "p05_dd", 0.05), ("dd", "p50_dd", 0.5)]


@query("block_bootstrap", sql("trades", BOOT, "SELECT cfg, " + ", ".join(
    rd(f"list_sort(list({c}))[{int(p * (SIMS - 1)) + 1}]", 4) + f" AS {n}" for c, n, p in QS) + ", avg(CASE WHEN total IS NULL THEN NULL WHEN round(total, 6) < 0 THEN 1 ELSE 0 END) AS p_loss "
    "FROM (SELECT DISTINCT cfg FROM dp) LEFT JOIN pt USING (cfg) GROUP BY 1"))
def block_bootstrap(spark, sf):
    daily = M.daily_sums(trades(spark, sf), ["cfg"], F.col("ret") * 1000)
    s = RB.bootstrap_summary(RB.block_paths(daily, "cfg", SIMS), "cfg")
    s = daily.select("cfg").distinct().join(s, "cfg", "left")
    return s.select("cfg", *[r(F.col(n), 4).alias(n) for _, n, _ in QS], "p_loss")


READY = (
    "pn AS MATERIALIZED (SELECT *, ret * qty AS pnl, (ret - 3 * fee / 100) * qty AS stressed FROM tb), cu AS (SELECT max(entry_ts) - INTERVAL 360 DAY AS cut FROM trades), "
    f"bs AS (SELECT cfg, {pf_sql('CASE WHEN entry_ts < cut THEN pnl END')} AS train_pf, {pf_sql('CASE WHEN entry_ts >= cut THEN pnl END')} AS hold_pf, {pf_sql('CASE WHEN entry_ts >= cut THEN stressed END')} AS stress_pf FROM pn, cu GROUP BY 1), "
    "mo AS (SELECT cfg, avg(CASE WHEN p > 0 THEN 1 ELSE 0 END) AS positive_months, count(*) FILTER (WHERE p > 0) AS good_months, count(*) AS months, min(p) AS worst_month FROM (SELECT cfg, date_trunc('month', entry_ts) AS m, sum(pnl) AS p FROM pn GROUP BY 1, 2) GROUP BY 1), "
    "ls AS (SELECT cfg, avg(CASE WHEN round(total, 6) < 0 THEN 1 ELSE 0 END) AS p_loss FROM pt GROUP BY 1), "
    "tp AS (SELECT cfg, sum(CASE WHEN rn <= 10 THEN pnl END) / sum(pnl) AS top_share FROM (SELECT *, row_number() OVER (PARTITION BY cfg ORDER BY pnl DESC) AS rn FROM pn WHERE pnl > 0) GROUP BY 1), "
    "al AS (SELECT *, [train_pf >= 1, hold_pf >= 1.1, stress_pf >= 1, positive_months >= 0.6, p_loss <= 0.25, top_share <= 0.35] AS ck FROM bs JOIN mo USING (cfg) LEFT JOIN ls USING (cfg) LEFT JOIN tp USING (cfg)), "
    "a2 AS (SELECT *, len(list_filter(ck, lambda x: NOT coalesce(x, false))) AS miss FROM al)"
)
READY_COLS = ["train_pf", "hold_pf", "stress_pf", "positive_months", "worst_month", "p_loss", "top_share", "max_drawdown"]
BOOK = "tb AS MATERIALIZED (SELECT * FROM trades UNION ALL SELECT * REPLACE ('ALL' AS cfg) FROM trades)"
BOOK_DD = re.sub(r"\b(cm|pk)\b", r"d\1", DD.format(k="cfg", src="dp"))
READY_BOOT = BOOT.replace("sum(ret * 1000) AS pnl", "sum(ret * qty) AS pnl").replace("FROM trades", "FROM tb")


@query("readiness_verdict", sql("trades", BOOK, READY_BOOT, READY, BOOK_DD,
       "SELECT cfg, good_months, months, " + ", ".join(f"{rd(c)} AS {c}" for c in READY_COLS) + ", CASE WHEN miss = 0 THEN 'READY' WHEN miss >= 2 THEN 'NOT READY' ELSE 'BORDERLINE' END AS verdict FROM a2 JOIN dd USING (cfg)"))
def readiness_verdict(spark, sf):
    """Every setup and the whole book (``ALL``): the book's paths draw one set of days for all setups."""
    t = trades(spark, sf).withColumn("cfg", F.explode(F.array("cfg", F.lit("ALL"))))
    net = F.col("ret") - 2 * (STRESS - 1) * F.col("fee") / 100
    t = t.withColumns({"pnl": F.col("ret") * F.col("qty"), "stressed": net * F.col("qty")})
    v = RB.readiness_report(t, "cfg", L.cutoff(t, 360), SIMS)
    return v.select("cfg", "good_months", "months", *[r(F.col(c)).alias(c) for c in READY_COLS], "verdict")


MUT_EXITS = ["r1", "r2", "time24", "trail"]
MUT = (
    "ld AS (SELECT run_id, symbol % 9 AS k, symbol % 4 AS t, strategy = 'F' AS gated FROM (SELECT *, row_number() OVER (PARTITION BY sweep_tag ORDER BY metric DESC, run_id) AS rn FROM runs) WHERE rn <= 40), "
    "l2 AS (SELECT *, " + LCG.format(x="run_id") + " AS h1 FROM ld), l3 AS (SELECT *, " + LCG.format(x="h1") + " AS h2 FROM l2), "
    "op AS (SELECT *, (h1 // 65536) % 100 AS op, h2 // 65536 AS v FROM l3), "
    "nw AS (SELECT run_id, CASE WHEN op >= 30 AND op < 55 THEN v % 9 ELSE k END AS k, CASE WHEN op >= 55 AND op < 75 THEN v % 4 ELSE t END AS t, "
    "CASE WHEN op < 30 THEN v % 4 ELSE 0 END AS x, CASE WHEN op >= 75 THEN NOT (gated AND v % 10 < 4) ELSE gated END AS gated FROM op)"
)


@query(
    "explore_mutations",
    sql("runs", MUT,
        "SELECT run_id, ['" + "', '".join(KINDS) + "'][k + 1] || '|' || ['4h', '2h', '1h', '30min'][t + 1] || '|' || ['" + "', '".join(MUT_EXITS)
        + "'][x + 1] || '|' || CASE WHEN gated THEN 'gated' ELSE 'open' END AS sig FROM nw"),
)
def explore_mutations(spark, sf):
    """One change to each of the 40 leaders of every sweep: exit, entry family, timeframe or gate."""
    leaders = best_per(runs(spark, sf), ["sweep_tag"], [F.desc("metric"), F.col("run_id")], 40)

    def lcg(x):
        return F.pmod(F.lit(1103515245).cast("long") * (x + 12345) + 12345, F.lit(2147483648))

    def draw(h):
        return F.floor(h / F.lit(65536))

    h1 = lcg(F.col("run_id"))
    op, v = F.pmod(draw(h1), F.lit(100)), draw(lcg(h1))

    def option(names, i):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))

    gated = F.col("strategy") == "F"
    kind = F.when((op >= 30) & (op < 55), F.pmod(v, F.lit(9))).otherwise(F.col("symbol") % 9)
    tf = F.when((op >= 55) & (op < 75), F.pmod(v, F.lit(4))).otherwise(F.col("symbol") % 4)
    leave = F.when(op < 30, F.pmod(v, F.lit(4))).otherwise(F.lit(0))
    gate = F.when(op >= 75, ~(gated & (F.pmod(v, F.lit(10)) < 4))).otherwise(gated)
    return leaders.select(
        "run_id",
        F.concat_ws(
            "|", option(KINDS, kind), option(["4h", "2h", "1h", "30min"], tf), option(MUT_EXITS, leave),
            F.when(gate, "gated").otherwise("open"),
        ).alias("sig"),
    )
