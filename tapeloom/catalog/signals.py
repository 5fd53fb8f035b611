"""Entry events of every family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import ema_cte, full, lagged, ny, query, rd, rsi_cte, sql
from tapeloom.catalog.indicators import BOLL, DIDI, MACD, adx_cte, vwap_cte
from tapeloom.functions.columns import ntz, r
from tapeloom.operators import signals as S
from tapeloom.sources.tables import bars, numbered


def events(df):
    return df.select("symbol", ntz(F.col("ts")).alias("ts"), F.col("dir").cast("long").alias("dir"))


def event_sql(source: str, up: str, dn: str) -> str:
    return (
        f"SELECT symbol, ts, CAST(1 AS BIGINT) AS dir FROM {source} WHERE {up} UNION ALL "
        f"SELECT symbol, ts, CAST(-1 AS BIGINT) AS dir FROM {source} WHERE {dn}"
    )


def cross_sql(source: str, diff: str) -> str:
    return (
        f"c AS (SELECT *, {diff} AS x, {lagged(diff)} AS p FROM {source}) "
        + event_sql("c", "x > 0 AND p <= 0", "x < 0 AND p >= 0")
    )


def cross_query(*parts: str, source: str, diff: str, base: str = "n1h") -> str:
    """All CTE parts, then the sign changes of ``diff``."""
    return sql(base, *parts, "SELECT 1").replace(" SELECT 1", ", " + cross_sql(source, diff))


MA = f"m AS MATERIALIZED (SELECT *, {full('avg(close)', 5)} - {full('avg(close)', 13)} AS d FROM n1h)"


@query("ma_cross", cross_query(MA, source="m", diff="d"))
def ma_cross(spark, sf):
    return events(S.ma_cross(numbered(spark, sf, "1h"), 5, 13))


EMA_PAIR = (
    ema_cte("f", "n1h", "close", 9) + ", " + ema_cte("s", "n1h", "close", 21)
    + ", m AS MATERIALIZED (SELECT n1h.*, f - s AS d FROM n1h JOIN f USING (symbol, bar_no) JOIN s USING (symbol, bar_no))"
)


@query("ema_cross", cross_query(EMA_PAIR, source="m", diff="d").replace("x > 0 AND", "bar_no > 0 AND x > 0 AND"))
def ema_cross(spark, sf):
    return events(S.ma_cross(numbered(spark, sf, "1h"), 9, 21, "ema"))


DON = (
    f"w AS (SELECT *, {full('max(high)', 20, -1)} AS hh, {full('min(low)', 20, -1)} AS ll FROM n1h), "
    "ab AS (SELECT *, coalesce(close > hh, false) AS a, coalesce(close < ll, false) AS b FROM w), "
    f"e AS (SELECT *, coalesce({lagged('a')}, false) AS ap, coalesce({lagged('b')}, false) AS bp FROM ab)"
)


@query("donchian_events", sql("n1h", DON, event_sql("e", "a AND NOT ap", "b AND NOT bp")))
def donchian_events(spark, sf):
    return events(S.donchian(numbered(spark, sf, "1h"), 20))


def band_flags(sd: str, dev: float, window: int = 20) -> str:
    return (
        f"w AS (SELECT *, {full('avg(close)', window)} AS mid, {full(f'{sd}(close)', window)} AS sd FROM n1h), "
        f"ab AS (SELECT *, coalesce(close > mid + {dev} * sd, false) AS a, coalesce(close < mid - {dev} * sd, false) AS b FROM w), "
        f"e AS (SELECT *, coalesce({lagged('a')}, false) AS ap, coalesce({lagged('b')}, false) AS bp, "
        f"coalesce({lagged('a', 2)}, false) AS ap2, coalesce({lagged('b', 2)}, false) AS bp2, "
        f"{lagged('low')} AS pl, {lagged('high')} AS ph, {lagged(ny('ts'))} AS pwall FROM ab)"
    )


@query(
    "boll_events",
    sql(
        "n1h",
        band_flags("stddev_samp", 1.5),
        "SELECT 'trend' AS mode, * FROM (" + event_sql("e", "a AND NOT ap", "b AND NOT bp")
        + ") UNION ALL SELECT 'revert' AS mode, * FROM (" + event_sql("e", "NOT b AND bp", "NOT a AND ap") + ")",
    ),
)
def boll_events(spark, sf):
    n = numbered(spark, sf, "1h")
    parts = [
        events(S.boll(n, 20, 1.5, mode)).withColumn("mode", F.lit(mode)) for mode in ("trend", "revert")
    ]
    return parts[0].unionByName(parts[1])


@query("macd_events", cross_query(MACD, source="m", diff="macd_line - macd_signal").replace("x > 0 AND", "bar_no > 0 AND x > 0 AND"))
def macd_events(spark, sf):
    return events(S.macd(numbered(spark, sf, "1h")))


@query(
    "momentum",
    sql(
        "n1h",
        f"w AS (SELECT *, close / nullif({lagged('close', 10)}, 0) - 1 AS x FROM n1h), c AS (SELECT *, {lagged('x')} AS p FROM w)",
        event_sql("c", "x > 0.5 AND p <= 0.5", "x < -0.5 AND p >= -0.5"),
    ),
)
def momentum(spark, sf):
    return events(S.momentum(numbered(spark, sf, "1h"), 10, 0.5))


@query(
    "rsi_cross",
    sql(
        "n1h",
        rsi_cte("w", "n1h", 14),
        f"c AS (SELECT *, rsi AS x, {lagged('rsi')} AS p FROM w)",
        event_sql("c", "x > 45 AND p <= 45", "x < 55 AND p >= 55"),
    ),
)
def rsi_cross(spark, sf):
    return events(S.rsi_cross(numbered(spark, sf, "1h"), 14, 45, 55))


VW = (
    "c AS (SELECT *, close - (vwap - band) AS dl, close - (vwap + band) AS dh FROM v3), "
    "c2 AS (SELECT *, lag(dl) OVER (PARTITION BY symbol, day ORDER BY ts) AS dlp, "
    "lag(dh) OVER (PARTITION BY symbol, day ORDER BY ts) AS dhp FROM c)"
)


@query(
    "vwap_events",
    sql(
        "b5m",
        vwap_cte(),
        VW,
        event_sql("c2", "session_bars >= 15 AND dl > 0 AND dlp <= 0", "session_bars >= 15 AND dh < 0 AND dhp >= 0"),
    ),
)
def vwap_events(spark, sf):
    e = S.vwap(None, numbered(spark, sf, "5min"), "5min", "revert", 1.5)
    return events(e.withColumnRenamed("entry_ts", "ts"))


ORB = (
    f"d AS (SELECT *, CAST({ny('ts')} AS DATE) AS day FROM n5m), "
    "s AS (SELECT symbol, day, min(ts) AS start_ts FROM d GROUP BY 1, 2), "
    "g AS (SELECT d.symbol, d.day, max(high) AS hi, min(low) AS lo FROM d JOIN s USING (symbol, day) "
    "WHERE ts < start_ts + INTERVAL 60 MINUTE GROUP BY 1, 2), "
    "h AS (SELECT d.symbol, d.day, ts, bar_no, CASE WHEN high > hi THEN 1 ELSE -1 END AS dir, "
    "CASE WHEN high > hi THEN greatest(open, hi) ELSE least(open, lo) END AS price FROM d JOIN s USING (symbol, day) "
    "JOIN g USING (symbol, day) WHERE ts >= start_ts + INTERVAL 60 MINUTE AND (high > hi OR low < lo)), "
    "f AS (SELECT symbol, day, min(bar_no) AS bar_no FROM h GROUP BY 1, 2)"
)


@query("orb", sql("n5m", ORB, "SELECT symbol, ts, CAST(dir AS BIGINT) AS dir, price FROM h JOIN f USING (symbol, day, bar_no)"))
def orb(spark, sf):
    e = S.orb(None, numbered(spark, sf, "5min"), "5min", 60)
    return e.select("symbol", ntz(F.col("entry_ts")).alias("ts"), F.col("dir").cast("long").alias("dir"), "price")


@query(
    "orb_mixed",
    sql(
        "n5m",
        "m AS (SELECT * REPLACE (CASE WHEN symbol = 'click' THEN 'clickUSDT' ELSE symbol END AS symbol) FROM n5m)",
        ORB.replace(f"CAST({ny('ts')} AS DATE) AS day FROM n5m", f"CAST(CASE WHEN symbol LIKE '%USDT' THEN ts ELSE {ny('ts')} END AS DATE) AS day FROM m"),
        "SELECT symbol, ts, CAST(dir AS BIGINT) AS dir, price FROM h JOIN f USING (symbol, day, bar_no)",
    ),
)
def orb_mixed(spark, sf):
    """Opening ranges of stocks and coins in one table, each on its own day."""
    n = numbered(spark, sf, "5min")
    n = n.withColumn("symbol", F.when(F.col("symbol") == "click", "clickUSDT").otherwise(F.col("symbol")))
    e = S.orb(None, n, "5min", 60)
    return e.select("symbol", ntz(F.col("entry_ts")).alias("ts"), F.col("dir").cast("long").alias("dir"), "price")


AGU = (
    DIDI
    + ", x1 AS (SELECT *, f / m - 1 AS c, s / m - 1 AS l FROM w), "
    f"x2 AS (SELECT *, {lagged('c')} AS cp, {lagged('l')} AS lp FROM x1), "
    "x3 AS (SELECT *, coalesce(c > 0 AND cp <= 0, false) AS cu, coalesce(c < 0 AND cp >= 0, false) AS cd, "
    "coalesce(l > 0 AND lp <= 0, false) AS lu, coalesce(l < 0 AND lp >= 0, false) AS ld FROM x2), "
    + "x4 AS (SELECT *, "
    + ", ".join(
        f"bool_or({k}) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS w{k}"
        for k in ("cu", "cd", "lu", "ld")
    )
    + " FROM x3), x5 AS (SELECT *, coalesce(wcu AND wld AND c > 0 AND l < 0, false) AS alta, "
    "coalesce(wcd AND wlu AND c < 0 AND l > 0, false) AS baixa FROM x4), "
    f"x6 AS MATERIALIZED (SELECT *, alta AND NOT coalesce({lagged('alta')}, false) AS a, "
    f"baixa AND NOT coalesce({lagged('baixa')}, false) AS b FROM x5)"
)


@query(
    "agulhada",
    sql("n1h", AGU, "SELECT symbol, ts, CAST(1 AS BIGINT) AS dir, high AS trigger FROM x6 WHERE a UNION ALL "
        "SELECT symbol, ts, CAST(-1 AS BIGINT), low FROM x6 WHERE b"),
)
def agulhada(spark, sf):
    e = S.agulhada(numbered(spark, sf, "1h"), tol_bars=2)
    return e.select("symbol", ntz(F.col("ts")).alias("ts"), F.col("dir").cast("long").alias("dir"), "trigger")


ADX_OK = (
    adx_cte()
    + f", ok AS MATERIALIZED (SELECT *, coalesce(adx > 25 AND adx - {lagged('adx')} > 0 AND plus_di > minus_di, false) AS long_ok, "
    f"coalesce(adx > 25 AND adx - {lagged('adx')} > 0 AND minus_di > plus_di, false) AS short_ok FROM a)"
)


@query("adx_confirm", sql("n1h", ADX_OK, "SELECT symbol, ts, long_ok, short_ok FROM ok"))
def adx_confirm(spark, sf):
    return S.adx_confirm(numbered(spark, sf, "1h"), threshold=25).select(
        "symbol", ntz(F.col("ts")).alias("ts"), "long_ok", "short_ok"
    )


@query(
    "didi_events",
    sql("n1h", AGU, ADX_OK,
        "SELECT x6.symbol, x6.ts, CAST(CASE WHEN x6.a THEN 1 ELSE -1 END AS BIGINT) AS dir FROM x6 JOIN ok USING (symbol, bar_no) "
        "WHERE (x6.a AND long_ok) OR (x6.b AND short_ok)"),
)
def didi_events(spark, sf):
    return events(S.didi(numbered(spark, sf, "1h"), tol_bars=2, adx_filter=True, adx_threshold=25))


def fffd_sql(extra: str = "", strict: bool = False, cols: str = "ts") -> str:
    lo = " AND NOT bp2" if strict else ""
    hi = " AND NOT ap2" if strict else ""
    return (
        f"SELECT symbol, ts, CAST(1 AS BIGINT) AS dir, high AS trigger, least(pl, low) AS stop FROM e WHERE bp AND NOT b{lo}{extra} "
        f"UNION ALL SELECT symbol, ts, CAST(-1 AS BIGINT), low, greatest(ph, high) FROM e WHERE ap AND NOT a{hi}{extra}"
    )


def levels(e):
    return e.select("symbol", ntz(F.col("ts")).alias("ts"), F.col("dir").cast("long").alias("dir"), "trigger", "stop")


@query("fffd_signals", sql("n1h", band_flags("stddev_pop", 1.5), fffd_sql()))
def fffd_signals(spark, sf):
    return levels(S.fffd(numbered(spark, sf, "1h"), 1.5))


@query("fffd_strict", sql("n1h", band_flags("stddev_pop", 1.5), fffd_sql(strict=True)))
def fffd_strict(spark, sf):
    return levels(S.fffd(numbered(spark, sf, "1h"), 1.5, strict=True))


@query(
    "fffd_intraday",
    sql("n1h", band_flags("stddev_pop", 1.5), fffd_sql(f" AND CAST(pwall AS DATE) = CAST({ny('ts')} AS DATE)")),
)
def fffd_intraday(spark, sf):
    return levels(S.fffd(numbered(spark, sf, "1h"), 1.5, same_session=True))


MIDX = f"w AS MATERIALIZED (SELECT *, close - {full('avg(close)', 20)} AS d FROM n1h)"


@query("midband_exit", cross_query(MIDX, source="w", diff="d"))
def midband_exit(spark, sf):
    return events(S.midband_exits(numbered(spark, sf, "1h")))


@query(
    "entry_delay",
    sql("n1h", band_flags("stddev_pop", 1.5), "z AS (" + fffd_sql() + ")",
        "SELECT z.symbol, z.ts, z.dir, y.ts AS entry_ts, y.open AS price FROM z JOIN n1h x ON x.symbol = z.symbol AND x.ts = z.ts "
        "JOIN n1h y ON y.symbol = x.symbol AND y.bar_no = x.bar_no + 1"),
)
def entry_delay(spark, sf):
    n = numbered(spark, sf, "1h")
    d = S.delayed(S.fffd(n, 1.5), n, 1)
    return d.select(
        "symbol", ntz(F.col("ts")).alias("ts"), F.col("dir").cast("long").alias("dir"),
        ntz(F.col("entry_ts")).alias("entry_ts"), "price",
    )


FF = (
    band_flags("stddev_pop", 1.5)
    + f", vv AS (SELECT *, {full('avg(volume)', 20)} AS av FROM e), "
    "z AS (SELECT symbol, ts, 1 AS dir, low * 0.99 AS lim FROM vv WHERE b AND volume >= 0.5 * av UNION ALL "
    "SELECT symbol, ts, -1, high * 1.01 FROM vv WHERE a AND volume >= 0.5 * av), "
    f"d AS MATERIALIZED (SELECT *, CAST({ny('ts')} AS DATE) AS day FROM n15m), "
    "act AS (SELECT z.*, d.bar_no AS act, d.day AS aday FROM (SELECT *, ts + INTERVAL 1 HOUR AS seen FROM z) z "
    "ASOF JOIN d ON z.symbol = d.symbol AND z.seen <= d.ts), "
    "walk AS (SELECT act.symbol, act.ts, dir, lim, aday, act.act, max(high) AS hi, min(low) AS lo, max(d.bar_no) AS p, "
    "arg_max(close, d.bar_no) AS c, arg_max(d.ts, d.bar_no) AS entry_ts, arg_max(d.day, d.bar_no) AS pday "
    "FROM act JOIN d ON d.symbol = act.symbol AND d.bar_no BETWEEN act.act AND act.act + 2 GROUP BY ALL), "
    "hit AS (SELECT symbol, entry_ts, dir, c AS price, ts, greatest(dir * (c - lim) / c, 0.001) AS stop_pct FROM walk "
    "WHERE p = act + 2 AND pday = aday AND (CASE WHEN dir = 1 THEN lo >= lim ELSE hi <= lim END))"
)


@query(
    "fffd_ff",
    sql("n1h n15m", FF, f"SELECT symbol, entry_ts, CAST(dir AS BIGINT) AS dir, price, {rd('arg_max(stop_pct, ts)')} AS stop_pct "
        "FROM hit GROUP BY ALL"),
)
def fffd_ff(spark, sf):
    e = S.fffd_ff(
        numbered(spark, sf, "1h"), numbered(spark, sf, "15min"), "1h", dev=1.5, wait_bars=3, vol_mult=0.5, tol=0.01
    )
    return entries(e)


def entries(e):
    return e.select(
        "symbol", ntz(F.col("entry_ts")).alias("entry_ts"), F.col("dir").cast("long").alias("dir"), "price",
        r(F.col("stop_pct")).alias("stop_pct"),
    )


WICK = (
    f"w AS (SELECT *, {full('avg(close)', 10)} AS mid, {full('stddev_pop(close)', 10)} AS sd FROM n1h), "
    "pn AS (SELECT *, coalesce(low <= mid - 1.0 * sd AND least(open, close) - low >= 0.2 * greatest(abs(close - open), close * 1e-4), false) AS plo, "
    "coalesce(high >= mid + 1.0 * sd AND high - greatest(open, close) >= 0.2 * greatest(abs(close - open), close * 1e-4), false) AS phi FROM w), "
    f"tw AS (SELECT *, plo AND coalesce({lagged('plo')}, false) AS two_lo, phi AND coalesce({lagged('phi')}, false) AS two_hi FROM pn), "
    "z AS (SELECT symbol, ts, ts + INTERVAL 1 HOUR AS seen, 1 AS dir FROM tw WHERE two_lo UNION ALL "
    "SELECT symbol, ts, ts + INTERVAL 1 HOUR, -1 FROM tw WHERE two_hi), "
    f"d AS MATERIALIZED (SELECT *, CAST({ny('ts')} AS DATE) AS day, {full('avg(close)', 50)} AS ma FROM n15m), "
    "act AS (SELECT z.*, d.bar_no AS act, d.day AS aday FROM z ASOF JOIN d ON z.symbol = d.symbol AND z.seen <= d.ts), "
    "walk AS (SELECT act.symbol, act.ts, dir, d.bar_no, d.ts AS entry_ts, close, ma, "
    "(CASE WHEN dir = 1 THEN close > ma ELSE close < ma END) AS ok, "
    "bool_or(ma IS NULL OR day <> aday) OVER (PARTITION BY act.symbol, act.ts, dir ORDER BY d.bar_no) AS dead "
    "FROM act JOIN d ON d.symbol = act.symbol AND d.bar_no BETWEEN act.act AND act.act + 5), "
    "hit AS (SELECT symbol, ts, dir, min(bar_no) AS bar_no FROM walk WHERE ok AND NOT dead GROUP BY 1, 2, 3)"
)


@query(
    "wick_bb",
    sql("n1h n15m", WICK,
        f"SELECT DISTINCT symbol, entry_ts, CAST(dir AS BIGINT) AS dir, close AS price, {rd('greatest(abs(close - ma) / close, 0.001)')} AS stop_pct "
        "FROM walk JOIN hit USING (symbol, ts, dir, bar_no)"),
)
def wick_bb(spark, sf):
    return entries(
        S.wick_bb(numbered(spark, sf, "1h"), numbered(spark, sf, "15min"), "1h", dev=1.0, wick_k=0.2, window=10, trend=50)
    )
