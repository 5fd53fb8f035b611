"""Alignment and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import (
    GROWTH,
    ema_cte, ewm_cte, full, lagged, ny, query, rd, rsi_cte, sql, win,
)
from tapeloom.functions.columns import floor_ts, ntz, r
from tapeloom.operators import gates as G
from tapeloom.operators import metrics as M
from tapeloom.operators import indicators as I
from tapeloom.operators.asof import activate, align_setup, asof
from tapeloom.operators.series import (
    DAY, Step, chain, ema, ema_alpha, ewm_step, full_avg, prefix_scan, time_bucket,
)
from tapeloom.sources.tables import bars, numbered, ticks, trades


def out(df, *cols):
    """ts, symbol and rounded value columns."""
    return df.select("symbol", ntz(F.col("ts")).alias("ts"), *[r(F.col(c)).alias(c) for c in cols])


def rsel(*cols):
    return "symbol, ts, " + ", ".join(f"{rd(c)} AS {c}" for c in cols)


# ---------------------------------------------------------------- as-of


@query(
    "asof_backward",
    sql(
        "b15m b4h",
        "s AS (SELECT symbol, ts + INTERVAL 4 HOUR AS seen, close FROM b4h)",
        "SELECT b.symbol, b.ts, b.close, s.close AS setup_close FROM b15m b ASOF LEFT JOIN s "
        "ON b.symbol = s.symbol AND b.ts >= s.seen",
    ),
)
def asof_backward(spark, sf):
    hit = align_setup(bars(spark, sf, "15min"), bars(spark, sf, "4h"), "4h", {"close": "setup_close"})
    return out(hit, "close", "setup_close")


@query(
    "asof_forward",
    sql(
        "b1h b15m",
        "s AS (SELECT symbol, ts, ts + INTERVAL 1 HOUR AS seen FROM b1h)",
        "SELECT s.symbol, s.ts, b.ts AS act_ts FROM s ASOF JOIN b15m b ON s.symbol = b.symbol AND s.seen <= b.ts",
    ),
)
def asof_forward(spark, sf):
    hit = activate(bars(spark, sf, "1h"), bars(spark, sf, "15min"), "1h", {"ts": "act_ts"})
    return hit.select("symbol", ntz(F.col("ts")).alias("ts"), ntz(F.col("act_ts")).alias("act_ts"))


@query(
    "asof_strict",
    sql(
        "b1h b1d",
        "SELECT b.symbol, b.ts, d.close AS prior_close FROM b1h b ASOF LEFT JOIN b1d d "
        "ON b.symbol = d.symbol AND date_trunc('day', b.ts) > d.ts",
    ),
)
def asof_strict(spark, sf):
    probe = bars(spark, sf, "1h").withColumn("day", floor_ts(F.col("ts"), DAY))
    hit = asof(probe, bars(spark, sf, "1d"), probe_ts="day", cols={"close": "prior_close"}, allow_equal=False)
    return out(hit, "prior_close")


@query(
    "trade_features",
    sql(
        "n1h trades",
        f"f AS MATERIALIZED (SELECT symbol, ts, {full('avg(close)', 20)} AS sma_20 FROM n1h), "
        "nm AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS names FROM events), "
        "e AS (SELECT order_id, line_no, part_id, qty, ret, names[1 + symbol % len(names)] AS symbol, "
        "TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (order_id % 720) AS ts FROM trades, nm)",
        f"SELECT order_id, line_no, part_id, qty, ret, ts, {rd('sma_20')} AS sma_20 FROM e LEFT JOIN f USING (symbol, ts)",
    ),
)
def trade_features(spark, sf):
    """Features of the bar a trade was entered on, by exact time; all trades stay. Trades are dealt over the tick symbols."""
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    names = ticks(spark, sf).agg(F.array_sort(F.collect_set("symbol")).alias("names"))  # one row per symbol at most
    entries = trades(spark, sf).withColumn("names", F.lit(names.first()[0])).select(
        "order_id", "line_no", "part_id", "qty", "ret",
        F.element_at("names", (F.pmod("symbol", F.size("names")) + 1).cast("int")).alias("symbol"),
        F.timestamp_seconds(start + F.pmod("order_id", F.lit(720)) * 3600).alias("ts"),
    )
    feats = I.sma(numbered(spark, sf, "1h"), [20]).select("symbol", "ts", "sma_20")
    hit = entries.join(feats, ["symbol", "ts"], "left")
    return hit.select("order_id", "line_no", "part_id", "qty", "ret", ntz(F.col("ts")).alias("ts"), r(F.col("sma_20")).alias("sma_20"))


# ---------------------------------------------------------------- rolling


@query("sma", sql("n15m", f"SELECT symbol, ts, {rd(full('avg(close)', 20))} AS sma_20, {rd(full('avg(close)', 50))} AS sma_50 FROM n15m"))
def sma(spark, sf):
    return out(I.sma(numbered(spark, sf, "15min"), [20, 50]), "sma_20", "sma_50")


BOLL = (
    f"w AS (SELECT *, {full('avg(close)', 20)} AS mid, {full('stddev_pop(close)', 20)} AS sd FROM n1h)"
)


@query("bollinger", sql("n1h", BOLL, f"SELECT symbol, ts, {rd('mid')} AS mid, {rd('mid - 2 * sd')} AS lower, {rd('mid + 2 * sd')} AS upper FROM w"))
def bollinger(spark, sf):
    return out(I.bollinger(numbered(spark, sf, "1h")), "mid", "lower", "upper")


@query(
    "donchian",
    sql(
        "n1h",
        f"SELECT symbol, ts, {full('max(high)', 20, -1)} AS prior_high, {full('min(low)', 20, -1)} AS prior_low FROM n1h",
    ),
)
def donchian(spark, sf):
    return out(I.donchian(numbered(spark, sf, "1h"), 20), "prior_high", "prior_low")


@query("roc", sql("n1h", f"SELECT symbol, ts, {rd('close / nullif(' + lagged('close', 10) + ', 0) - 1')} AS roc FROM n1h"))
def roc(spark, sf):
    return out(I.roc(numbered(spark, sf, "1h"), 10), "roc")


DIDI = (
    f"w AS (SELECT *, {full('avg(close)', 3)} AS f, {full('avg(close)', 8)} AS m, {full('avg(close)', 20)} AS s FROM n1h)"
)


@query("didi", sql("n1h", DIDI, f"SELECT symbol, ts, {rd('f / m - 1')} AS curta, {rd('s / m - 1')} AS longa FROM w"))
def didi(spark, sf):
    return out(I.didi(numbered(spark, sf, "1h")), "curta", "longa")


# ---------------------------------------------------------------- exponential


@query(
    "ema",
    sql("n1h", ema_cte("ema_9", "n1h", "close", 9), ema_cte("ema_200", "n1h", "close", 200),
        f"SELECT symbol, ts, {rd('ema_9')} AS ema_9, {rd('ema_200')} AS ema_200 FROM n1h JOIN ema_9 USING (symbol, bar_no) "
        "JOIN ema_200 USING (symbol, bar_no)"),
)
def ema_query(spark, sf):
    n = numbered(spark, sf, "1h")
    return out(ema(ema(n, "close", 9, "ema_9"), "close", 200, "ema_200"), "ema_9", "ema_200")


@query("rsi", sql("n1h", rsi_cte("w", "n1h", 14), f"SELECT {rsel('rsi')} FROM w"))
def rsi(spark, sf):
    return out(I.rsi(numbered(spark, sf, "1h"), 14), "rsi")


MACD = (
    ema_cte("f", "n1h", "close", 12) + ", " + ema_cte("s", "n1h", "close", 26)
    + ", line AS MATERIALIZED (SELECT n.*, f - s AS macd_line FROM n1h n JOIN f USING (symbol, bar_no) JOIN s USING (symbol, bar_no)), "
    + ema_cte("sg", "line", "macd_line", 9)
    + ", m AS MATERIALIZED (SELECT line.*, sg AS macd_signal FROM line JOIN sg USING (symbol, bar_no))"
)


@query("macd", sql("n1h", MACD, f"SELECT {rsel('macd_line', 'macd_signal')} FROM m"))
def macd(spark, sf):
    return out(I.macd(numbered(spark, sf, "1h")), "macd_line", "macd_signal")


def adx_cte(n: int = 8) -> str:
    return (
        "mv AS MATERIALIZED (SELECT *, coalesce(high - " + lagged("high") + ", 0) AS up, coalesce(" + lagged("low")
        + " - low, 0) AS dn, greatest(high - low, abs(high - " + lagged("close") + "), abs(low - " + lagged("close")
        + ")) AS tr FROM n1h), "
        + ewm_cte(
            "sm", "mv",
            {
                "p": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END",
                "mn": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END",
                "atr": "tr",
            },
            f"(1.0::DOUBLE / {n})",
        )
        + ", di AS MATERIALIZED (SELECT symbol, bar_no, 100 * p / nullif(atr, 0) AS plus_di, 100 * mn / nullif(atr, 0) AS minus_di FROM sm), "
        "dx AS MATERIALIZED (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM di), "
        "fx AS (SELECT symbol, min(bar_no) AS first_no FROM dx WHERE dx IS NOT NULL GROUP BY 1), "
        "dx2 AS MATERIALIZED (SELECT dx.*, bar_no - first_no AS q FROM dx JOIN fx USING (symbol)), "
        + ewm_cte("ax", "dx2", {"adx": "dx"}, f"(1.0::DOUBLE / {n})", "q")
        + ", a AS MATERIALIZED (SELECT n1h.*, plus_di, minus_di, adx FROM n1h JOIN di USING (symbol, bar_no) "
        "LEFT JOIN ax USING (symbol, bar_no))"
    )


@query("adx", sql("n1h", adx_cte(), f"SELECT {rsel('adx', 'plus_di', 'minus_di')} FROM a"))
def adx(spark, sf):
    return out(I.adx(numbered(spark, sf, "1h")), "adx", "plus_di", "minus_di")


def vwap_cte(source: str = "b5m") -> str:
    d = f"CAST({ny('ts')} AS DATE)"
    run = "(PARTITION BY symbol, day ORDER BY ts)"
    return (
        f"v0 AS (SELECT *, {d} AS day FROM {source}), "
        f"v1 AS (SELECT *, sum(close * volume) OVER {run} / nullif(sum(volume) OVER {run}, 0) AS vwap, "
        f"count(*) OVER {run} AS session_bars FROM v0), "
        f"v2 AS (SELECT *, sum(close - vwap) OVER {run} AS s1, sum((close - vwap) ** 2) OVER {run} AS s2 FROM v1), "
        "v3 AS MATERIALIZED (SELECT *, CASE WHEN vwap IS NOT NULL THEN 1.5 * sqrt(greatest(s2 / session_bars - (s1 / session_bars) ** 2, 0)) END AS band FROM v2)"
    )


@query("session_vwap", sql("b5m", vwap_cte(), f"SELECT symbol, ts, {rd('vwap')} AS vwap, {rd('vwap - band')} AS vwap_lower, {rd('vwap + band')} AS vwap_upper FROM v3"))
def session_vwap(spark, sf):
    v = I.session_vwap(bars(spark, sf, "5min"))
    return v.select(
        "symbol", ntz(F.col("ts")).alias("ts"), *[r(F.col(c)).alias(c) for c in ("vwap", "vwap_lower", "vwap_upper")]
    )


@query(
    "equity_curve",
    sql(
        "trades",
        f"d AS (SELECT cfg, date_trunc('day', entry_ts) AS day, {GROWTH} FROM trades GROUP BY 1, 2)",
        f"SELECT cfg, day, {rd('CASE WHEN sum(lost) OVER (PARTITION BY cfg ORDER BY day) = 0 THEN sum(lr) OVER (PARTITION BY cfg ORDER BY day) END')} AS log_equity FROM d",
    ),
)
def equity_curve(spark, sf):
    """Compounded equity per day in log form, where returns add; NULL from a total loss on."""
    day = trades(spark, sf).groupBy("cfg", floor_ts(F.col("entry_ts"), DAY).alias("day")).agg(
        F.sum(M.log_growth(F.col("ret"))).alias("lr"), F.sum(M.ruined(F.col("ret"))).alias("lost")
    )
    curve = prefix_scan(
        day, ["cfg"], ["day"], time_bucket("day", 90 * DAY), {"log_equity": ("sum", F.col("lr")), "gone": ("sum", F.col("lost"))}
    )
    return curve.select("cfg", ntz(F.col("day")).alias("day"), r(F.when(F.col("gone") == 0, F.col("log_equity"))).alias("log_equity"))


# ---------------------------------------------------------------- matrices

LEVELS = [("sma", "1d", 10), ("sma", "1d", 5), ("ema", "4h", 21)]


def frames_of(spark, sf, tfs):
    return {tf: numbered(spark, sf, tf) for tf in tfs}


LEVEL_SQL = (
    f"d AS MATERIALIZED (SELECT *, ts + INTERVAL 1 DAY AS seen, {full('avg(close)', 10)} AS s10, {full('avg(close)', 5)} AS s5 FROM n1d), "
    f"d2 AS MATERIALIZED (SELECT *, sign(s10 - {lagged('s10')}) AS sl10, sign(s5 - {lagged('s5')}) AS sl5 FROM d), "
    + ema_cte("e21", "n4h", "close", 21)
    + f", q AS MATERIALIZED (SELECT n4h.symbol, n4h.ts + INTERVAL 4 HOUR AS seen, bar_no, e21 FROM n4h JOIN e21 USING (symbol, bar_no)), "
    f"q2 AS MATERIALIZED (SELECT *, sign(e21 - {lagged('e21')}) AS sle FROM q), "
    "lm AS MATERIALIZED (SELECT b.*, 100 * (b.close - s10) / s10 AS dist_sma10_1d, 100 * (b.close - s5) / s5 AS dist_sma5_1d, "
    "100 * (b.close - e21) / e21 AS dist_ema21_4h, CAST(sl10 AS DOUBLE) AS slope_sma10_1d, CAST(sl5 AS DOUBLE) AS slope_sma5_1d, "
    "CAST(sle AS DOUBLE) AS slope_ema21_4h, 100 * (b.close - d2.high) / nullif(d2.high, 0) AS dist_pdh, 100 * (b.close - d2.low) / nullif(d2.low, 0) AS dist_pdl "
    "FROM n1h b ASOF LEFT JOIN d2 ON b.symbol = d2.symbol AND b.ts >= d2.seen ASOF LEFT JOIN q2 ON b.symbol = q2.symbol AND b.ts >= q2.seen)"
)
LEVEL_COLS = [
    "dist_sma10_1d", "dist_sma5_1d", "dist_ema21_4h", "slope_sma10_1d", "slope_sma5_1d", "slope_ema21_4h",
    "dist_pdh", "dist_pdl",
]


@query("level_matrix", sql("n1h n1d n4h", LEVEL_SQL, f"SELECT {rsel(*LEVEL_COLS)} FROM lm"))
def level_matrix(spark, sf):
    return out(G.level_matrix(numbered(spark, sf, "1h"), frames_of(spark, sf, ["1d", "4h"]), LEVELS), *LEVEL_COLS)


RSI_MATRIX = ", ".join(rsi_cte(f"r{s}", f"n{s}", 14) for s in ("1d", "4h", "2h"))


@query(
    "rsi_matrix",
    sql(
        "n1h n1d n4h n2h",
        RSI_MATRIX,
        f"SELECT b.symbol, b.ts, {rd('a.rsi')} AS rsi_1d, {rd('c.rsi')} AS rsi_4h, {rd('e.rsi')} AS rsi_2h FROM n1h b "
        "ASOF LEFT JOIN (SELECT *, ts + INTERVAL 1 DAY AS seen FROM r1d) a ON b.symbol = a.symbol AND b.ts >= a.seen "
        "ASOF LEFT JOIN (SELECT *, ts + INTERVAL 4 HOUR AS seen FROM r4h) c ON b.symbol = c.symbol AND b.ts >= c.seen "
        "ASOF LEFT JOIN (SELECT *, ts + INTERVAL 2 HOUR AS seen FROM r2h) e ON b.symbol = e.symbol AND b.ts >= e.seen",
    ),
)
def rsi_matrix(spark, sf):
    tfs = ["1d", "4h", "2h"]
    m = G.rsi_matrix(numbered(spark, sf, "1h"), frames_of(spark, sf, tfs), tfs)
    return out(m, "rsi_1d", "rsi_4h", "rsi_2h")


#: candles per symbol that a chart shows
SHOWN = 300


@query(
    "candles_overlay",
    sql(
        "n1h",
        ema_cte("e21", "n1h", "close", 21),
        rsi_cte("rr", "n1h", 14),
        f"w AS MATERIALIZED (SELECT *, {full('avg(close)', 50)} AS sma_50, {full('avg(close)', 200)} AS sma_200, "
        f"sum((high + low + close) / 3 * volume) OVER (PARTITION BY symbol, CAST({ny('ts')} AS DATE) ORDER BY ts) / "
        f"nullif(sum(volume) OVER (PARTITION BY symbol, CAST({ny('ts')} AS DATE) ORDER BY ts), 0) AS vwap FROM n1h)",
        "m AS (SELECT symbol, max(bar_no) AS last_no FROM n1h GROUP BY 1)",
        f"SELECT w.symbol, w.ts, {rd('sma_50')} AS sma_50, {rd('sma_200')} AS sma_200, {rd('e21')} AS ema_21, {rd('rsi')} AS rsi, "
        f"{rd('vwap')} AS vwap FROM w JOIN e21 USING (symbol, bar_no) JOIN rr USING (symbol, bar_no) JOIN m USING (symbol) "
        f"WHERE bar_no > last_no - {SHOWN}",
    ),
)
def candles_overlay(spark, sf):
    """Overlays over the whole history, then the last 300 candles per symbol."""
    n = numbered(spark, sf, "1h")
    over = chain(
        n,
        Step(200, {"sma_50": full_avg("close", 50), "sma_200": full_avg("close", 200)}),
        ewm_step({"ema_21": (F.col("close"), ema_alpha(21))}),
        *I.rsi_steps(14),
    )
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    keep = over.withColumn("_close", F.col("close")).withColumn("close", typical)
    keep = I.session_vwap(keep).drop("close").withColumnRenamed("_close", "close")
    last = n.groupBy("symbol").agg(F.max("bar_no").alias("_last"))
    shown = keep.join(last, "symbol").where(F.col("bar_no") > F.col("_last") - SHOWN)
    return out(shown, "sma_50", "sma_200", "ema_21", "rsi", "vwap")
