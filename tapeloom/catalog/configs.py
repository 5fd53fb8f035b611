"""Queries over tables of configurations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tapeloom.catalog.base import lagged, ny, query, rd, rsi_cte, sql
from tapeloom.catalog.gates import TREND
from tapeloom.catalog.indicators import MACD, vwap_cte
from tapeloom.catalog.metrics import GROUP_COLS, group_columns
from tapeloom.catalog.signals import DON, MA, ORB, VW, band_flags, event_sql
from tapeloom.catalog.validation import FEES, session_sql
from tapeloom.functions.columns import r, tf_seconds
from tapeloom.plans import configs as C
from tapeloom.sources.tables import numbered

EXEC = "15min"
#: families beside the lab grid, each behind every gate
MORE = [
    {"kind": "ma_cross", "fast": 5, "slow": 13}, {"kind": "donchian", "window": 20}, {"kind": "boll", "window": 20, "dev": 1.5, "mode": "trend"},
    {"kind": "macd"}, {"kind": "mom", "window": 10, "thr": 0.5},
]
GATES = [None, {"ind": "session", "window": "open60"}, {"ind": "session", "window": "close90"}, {"ind": "trend", "tf": "4h", "ma": 10}]


def table_of_configs() -> list[dict]:
    more = [{"entry": e, "setup_tf": EXEC, "gate": g, "exit": {"sl": 0.01, "tp": 0.01}, "fee": f} for e in MORE for g in GATES for f in FEES]
    return C.lab_grid(EXEC, FEES) + more


def own(text: str, i: int) -> str:
    """CTE names of a snippet with a suffix of their own; bars move to 15 minutes."""
    names = re.findall(r"(?:^|, )(\w+) AS (?:MATERIALIZED )?\(SELECT", text)
    text = re.sub(r"\bn1h\b|\bn5m\b|\bb5m\b", "n15m", text)
    return re.sub(r"(?<![.'])\b(" + "|".join(sorted(set(names), key=len, reverse=True)) + r")\b(?= AS (?:MATERIALIZED )?\(SELECT|\.|\))|(?<=FROM )\b(" + "|".join(set(names)) + r")\b|(?<=JOIN )\b(" + "|".join(set(names)) + r")\b",
                  lambda m: f"{m[0]}_{i}", text)


def entry_sql(i: int, config: dict) -> tuple[str, str]:
    """(CTE parts, rows symbol, entry_no, dir, price) of one signal setting."""
    e, tf = config["entry"], config["setup_tf"]
    kind = e["kind"]
    if kind == "orb":
        return own(ORB.replace("60 MINUTE", f"{e['range_min']} MINUTE"), i), f"SELECT symbol, bar_no AS entry_no, dir, price FROM h_{i} JOIN f_{i} USING (symbol, day, bar_no)"
    if kind == "vwap":
        k = e["band_k"] / 1.5
        text = VW.replace("vwap - band", f"vwap - band * {k!r}").replace("vwap + band", f"vwap + band * {k!r}")
        if e["mode"] == "cross":
            text = VW.replace("(vwap - band)", "vwap").replace("(vwap + band)", "vwap")
        cond = event_sql(f"c2_{i}", "session_bars >= 15 AND dl > 0 AND dlp <= 0", "session_bars >= 15 AND dh < 0 AND dhp >= 0")
        return own(text, i), f"SELECT z.symbol, b.bar_no AS entry_no, z.dir, b.close AS price FROM ({cond}) z JOIN n15m b ON b.symbol = z.symbol AND b.ts = z.ts"
    wide = tf_seconds(tf) // 60
    if kind == "rsi_cross":
        source = {"30min": "n30m", "1h": "n1h"}[tf]
        parts = f"c_{i} AS (SELECT *, rsi AS x, {lagged('rsi')} AS p FROM w_{source})"
        cond = event_sql(f"c_{i}", f"x > {e['lo']} AND p <= {e['lo']}", f"x < {e['hi']} AND p >= {e['hi']}")
    elif kind in ("ma_cross", "macd"):
        diff, text = ("d", MA) if kind == "ma_cross" else ("macd_line - macd_signal", MACD)
        quiet = f"CASE WHEN abs({diff}) > abs(close) * 1e-12 THEN {diff} WHEN {diff} IS NOT NULL THEN 0 END"
        text = own(text, i) if kind == "ma_cross" else text.replace("n1h", "n15m")
        source = f"m_{i}" if kind == "ma_cross" else "m"
        parts = f"{text}, q_{i} AS (SELECT *, {quiet} AS x FROM {source}), r_{i} AS (SELECT *, {lagged('x')} AS p FROM q_{i})"
        cond = event_sql(f"r_{i}", "x > 0 AND p <= 0", "x < 0 AND p >= 0")
    elif kind == "mom":
        parts = f"w_{i} AS (SELECT *, close / nullif({lagged('close', 10)}, 0) - 1 AS x FROM n15m), c_{i} AS (SELECT *, {lagged('x')} AS p FROM w_{i})"
        cond = event_sql(f"c_{i}", "x > 0.5 AND p <= 0.5", "x < -0.5 AND p >= -0.5")
    else:
        parts = own(DON if kind == "donchian" else band_flags("stddev_samp", 1.5), i)
        cond = event_sql(f"e_{i}", "a AND NOT ap", "b AND NOT bp")
    rows = f"SELECT DISTINCT z.symbol, b.bar_no AS entry_no, z.dir, b.close AS price FROM (SELECT *, ts + INTERVAL {wide} MINUTE AS seen FROM ({cond})) z ASOF JOIN n15m b ON z.symbol = b.symbol AND z.seen <= b.ts"
    return parts, rows


def report_sql(configs: list[dict], bars: str = "n15m") -> str:
    """One SQL text for a table of configurations on the bars ``bars``."""
    sigs = {(C.name(c["entry"]), c["setup_tf"]): c for c in configs}
    parts, rows = [vwap_cte("n15m"), rsi_cte("w_n30m", "n30m", 14), rsi_cte("w_n1h", "n1h", 14)], []
    for i, c in enumerate(sigs.values()):
        text, select = entry_sql(i, c)
        parts.append(text)
        rows.append(f"SELECT {i} AS sig, * FROM ({select})")
    number = {k: i for i, k in enumerate(sigs)}
    lit = lambda v: "NULL" if v is None else repr(v)
    settings = {C.label(c): c for c in configs}
    values = ", ".join(
        f"('{k}', {number[C.name(c['entry']), c['setup_tf']]}, {GATES.index(c['gate'])}, {lit(c['exit'].get('sl'))}::DOUBLE, {lit(c['exit'].get('tp'))}::DOUBLE, {lit(c['exit'].get('max_bars'))}::INTEGER)"
        for k, c in settings.items()
    )
    minute = f"date_part('hour', {ny('b.ts')}) * 60 + date_part('minute', {ny('b.ts')}) - 570"
    run = [
        f"eg AS MATERIALIZED ({' UNION ALL '.join(rows)})", f"cf AS (SELECT * FROM (VALUES {values}) v(label, sig, gate, sl, tp, max_bars))",
        TREND.replace("n1h", "n15m"), session_sql("n15m"),
        "gt AS MATERIALIZED (SELECT b.symbol, b.bar_no, b.ts, " + minute + " AS mi, coalesce(above, false) AS above FROM n15m b JOIN j ON j.symbol = b.symbol AND j.ts = b.ts)",
        "hd AS MATERIALIZED (SELECT label, e.*, sl, tp, max_bars, gt.ts AS entry_ts, eod_no, eod_close FROM eg e JOIN cf USING (sig) JOIN gt ON gt.symbol = e.symbol AND gt.bar_no = e.entry_no JOIN ss ON ss.symbol = e.symbol AND ss.bar_no = e.entry_no "
        "WHERE NOT late AND NOT eod AND CASE gate WHEN 0 THEN true WHEN 1 THEN mi < 60 WHEN 2 THEN mi >= 300 ELSE CASE WHEN dir = 1 THEN above ELSE NOT above END END)",
        "fl AS (SELECT a.*, o.entry_no AS flip_no, o.price AS flip_px FROM hd a ASOF LEFT JOIN (SELECT symbol, label, -dir AS dir, entry_ts, entry_no, price FROM hd) o "
        "ON a.symbol = o.symbol AND a.label = o.label AND a.dir = o.dir AND a.entry_ts < o.entry_ts)",
        "lv AS (SELECT *, row_number() OVER () AS id, price * (1 - dir * sl) AS sll, price * (1 + dir * tp) AS tpl FROM fl)",
        "lm AS MATERIALIZED (SELECT * FROM lv)",
        "th AS (SELECT id, min(b.bar_no) FILTER (CASE WHEN dir = 1 THEN b.low <= sll ELSE b.high >= sll END) AS s_no, "
        "arg_min(CASE WHEN dir = 1 THEN least(b.open, sll) ELSE greatest(b.open, sll) END, b.bar_no) FILTER (CASE WHEN dir = 1 THEN b.low <= sll ELSE b.high >= sll END) AS s_px, "
        "min(b.bar_no) FILTER (CASE WHEN dir = 1 THEN b.high >= tpl ELSE b.low <= tpl END) AS t_no, "
        "arg_min(CASE WHEN dir = 1 THEN greatest(b.open, tpl) ELSE least(b.open, tpl) END, b.bar_no) FILTER (CASE WHEN dir = 1 THEN b.high >= tpl ELSE b.low <= tpl END) AS t_px, "
        "min(b.bar_no) FILTER (b.bar_no = entry_no + max_bars) AS m_no, any_value(b.close) FILTER (b.bar_no = entry_no + max_bars) AS m_px "
        "FROM lm JOIN n15m b ON b.symbol = lm.symbol AND b.bar_no BETWEEN entry_no + 1 AND eod_no GROUP BY id)",
        "ex AS MATERIALIZED (SELECT lm.*, least(s_no, t_no, flip_no, m_no, eod_no) AS exit_no, CASE least(s_no, t_no, flip_no, m_no, eod_no) WHEN s_no THEN s_px WHEN t_no THEN t_px WHEN flip_no THEN flip_px WHEN m_no THEN m_px ELSE eod_close END AS px FROM lm JOIN th USING (id))",
        "tr AS MATERIALIZED (SELECT ex.*, b.ts AS exit_ts, row_number() OVER (PARTITION BY ex.symbol, label ORDER BY entry_ts, b.ts, dir) AS no FROM ex JOIN n15m b ON b.symbol = ex.symbol AND b.bar_no = exit_no)",
        "fi AS (SELECT symbol, label, entry_ts, min(no) AS no FROM tr GROUP BY ALL)",
        "lk AS MATERIALIZED (SELECT a.symbol, a.label, a.no, CASE WHEN b.no IS NOT NULL THEN greatest(b.no, a.no + 1) END AS nxt FROM tr a ASOF LEFT JOIN fi b ON a.symbol = b.symbol AND a.label = b.label AND a.exit_ts <= b.entry_ts)",
        "ch AS (SELECT symbol, label, no, nxt FROM lk WHERE no = 1 UNION ALL SELECT lk.symbol, lk.label, lk.no, lk.nxt FROM ch JOIN lk ON lk.symbol = ch.symbol AND lk.label = ch.label AND lk.no = ch.nxt)",
        "nt AS (SELECT symbol, label, fee, dir * (px / price - 1) - 2 * (fee + 0.0001) AS ret FROM tr JOIN ch USING (symbol, label, no), (SELECT unnest([0.001, 0.0025])::DOUBLE AS fee))",
    ]
    end = f"SELECT symbol, label, fee, {GROUP_COLS} FROM nt GROUP BY symbol, label, fee"
    return sql(f"{bars} n30m n1h n4h", *[re.sub(r"\bn15m\b", bars, t) for t in (*parts, *run)], end, recursive=True)


@query("config_report", report_sql(table_of_configs()))
def config_report(spark, sf):
    """The lab grid and five more families behind four gates: 76 settings with two fees each, one plan."""
    frames = {tf: numbered(spark, sf, tf) for tf in (EXEC, "30min", "1h", "4h")}
    trades = C.run_table(table_of_configs(), frames, EXEC)
    return trades.groupBy("symbol", "label", "fee").agg(*group_columns())


FINE = "5min"
#: the given tape is no market: at the usual 30 trades and factor 1.1 no setting is viable on it
LEAST, FACTOR = 2, 0.05
LAB, LAB_FINE = C.lab_grid(EXEC, FEES), C.lab_grid(FINE, FEES)
NAMES = ", ".join(f"('{C.label(a)}', '{C.label(b)}')" for a, b in zip(LAB, LAB_FINE) if a["fee"] == FEES[0])
FUNNEL = (
    f"co AS MATERIALIZED ({report_sql(LAB)}), fi AS MATERIALIZED ({report_sql(LAB_FINE, 'n5m')}), "
    f"vi AS (SELECT symbol, label, pf FROM co WHERE fee = {min(FEES)} AND n >= {LEAST} AND pf >= {FACTOR}), "
    f"fa AS (SELECT label, count(*) AS n_viable, median(pf) AS median_pf FROM vi GROUP BY 1 ORDER BY n_viable DESC, median_pf DESC, label LIMIT {C.FAMILIES}), "
    f"na AS (SELECT * FROM (VALUES {NAMES}) v(label, fine))"
)


@query("lab_funnel", sql("", FUNNEL, f"SELECT fi.* EXCLUDE (label), na.label, n_viable, {rd('median_pf')} AS median_pf FROM fi JOIN na ON na.fine = fi.label JOIN fa ON fa.label = na.label JOIN vi ON vi.label = na.label AND vi.symbol = fi.symbol"))
def lab_funnel(spark, sf):
    """The lab grid on 15-minute bars, its families' scores, and the best ten again on 5-minute bars where they were viable."""
    frames = {tf: numbered(spark, sf, tf) for tf in (EXEC, FINE, "30min", "1h")}
    out = C.funnel(frames, EXEC, FINE, FEES, lambda t: t.groupBy("symbol", "label", "fee").agg(*group_columns()), LEAST, FACTOR)
    return out.withColumn("median_pf", r(F.col("median_pf")))
