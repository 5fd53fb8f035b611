"""Entry gates on hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import ema_cte, full, lagged, ny, query, rd, rsi_cte, sql
from tapeloom.catalog.indicators import LEVEL_SQL, LEVELS, frames_of
from tapeloom.catalog.signals import band_flags, fffd_sql
from tapeloom.functions.columns import floor_ts, ntz
from tapeloom.operators import gates as G
from tapeloom.operators import signals as S
from tapeloom.operators.bars import session_masks
from tapeloom.operators.series import DAY
from tapeloom.sources.tables import bars, numbered, ticks


def shown(df):
    return df.select("symbol", ntz(F.col("ts")).alias("ts"), "long_ok", "short_ok")


def ok_sql(source: str, long_ok: str, short_ok: str | None = None) -> str:
    return (
        f"SELECT symbol, ts, coalesce({long_ok}, false) AS long_ok, coalesce({short_ok or long_ok}, false) AS short_ok FROM {source}"
    )


DAYS = f"d AS MATERIALIZED (SELECT *, CAST({ny('ts')} AS DATE) AS day FROM n1h)"
GAP = (
    DAYS
    + ", g AS (SELECT symbol, day, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM d GROUP BY 1, 2), "
    "g2 AS (SELECT symbol, day, o / lag(c) OVER (PARTITION BY symbol ORDER BY day) - 1 AS gap FROM g), "
    "j AS (SELECT d.symbol, d.ts, gap FROM d JOIN g2 USING (symbol, day))"
)


@query("gap_gate", sql("n1h", GAP, ok_sql("j", "abs(gap) >= 0.5 AND gap > 0", "abs(gap) >= 0.5 AND gap < 0")))
def gap_gate(spark, sf):
    return shown(G.gap(numbered(spark, sf, "1h"), {}, min_gap_pct=50, mode="aligned"))


COMP = (
    DAYS
    + ", g AS (SELECT symbol, day, max(high) - min(low) AS rng FROM d GROUP BY 1, 2), "
    "g2 AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(rng) OVER w END AS m FROM g "
    "WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), "
    "g3 AS (SELECT symbol, day, lag(rng <= 0.95 * m) OVER (PARTITION BY symbol ORDER BY day) AS tight FROM g2), "
    "j AS (SELECT d.symbol, d.ts, tight FROM d JOIN g3 USING (symbol, day))"
)


@query("compression_gate", sql("n1h", COMP, ok_sql("j", "tight")))
def compression_gate(spark, sf):
    return shown(G.compression(numbered(spark, sf, "1h"), {}, q=0.95, days=5))


TREND = (
    f"t AS MATERIALIZED (SELECT symbol, ts + INTERVAL 4 HOUR AS seen, coalesce(close > {full('avg(close)', 10)}, false) AS above FROM n4h), "
    "j AS (SELECT b.symbol, b.ts, above FROM n1h b ASOF LEFT JOIN t ON b.symbol = t.symbol AND b.ts >= t.seen)"
)


@query("trend_gate", sql("n1h n4h", TREND, ok_sql("j", "above", "NOT above")))
def trend_gate(spark, sf):
    return shown(G.trend(numbered(spark, sf, "1h"), frames_of(spark, sf, ["4h"]), tf="4h", ma=10))


TREND_ALL = (
    ema_cte("e9", "n4h", "close", 9) + ", " + ema_cte("e21", "n4h", "close", 21)
    + f", t AS MATERIALIZED (SELECT symbol, bar_no, ts + INTERVAL 4 HOUR AS seen, close, {full('avg(close)', 5)} AS s1, "
    f"{full('avg(close)', 10)} AS s2, {full('avg(close)', 20)} AS s3 FROM n4h), "
    "t2 AS MATERIALIZED (SELECT symbol, seen, coalesce(close > s1 AND close > s2 AND close > s3 AND close > e9 AND close > e21, false) AS above, "
    "coalesce(close < s1 AND close < s2 AND close < s3 AND close < e9 AND close < e21, false) AS below "
    "FROM t JOIN e9 USING (symbol, bar_no) JOIN e21 USING (symbol, bar_no)), "
    "j AS (SELECT b.symbol, b.ts, above, below FROM n1h b ASOF LEFT JOIN t2 ON b.symbol = t2.symbol AND b.ts >= t2.seen)"
)


@query("trend_all_gate", sql("n1h n4h", TREND_ALL, ok_sql("j", "above", "below")))
def trend_all_gate(spark, sf):
    return shown(G.trend_all(numbered(spark, sf, "1h"), frames_of(spark, sf, ["4h"]), tf="4h", smas=(5, 10, 20)))


MIN = f"(date_part('hour', {ny('ts')}) * 60 + date_part('minute', {ny('ts')}) - 570)"
UMIN = "(date_part('hour', ts) * 60 + date_part('minute', ts))"


@query(
    "session_gate",
    sql(
        "n15m",
        f"SELECT symbol, ts, {MIN} < 60 AS open60, {MIN} >= 300 AS close90, {MIN} < 90 OR {MIN} >= 300 AS not_midday, "
        f"{UMIN} < 360 OR {UMIN} >= 1080 AS crypto_not_midday FROM n15m",
    ),
)
def session_gate(spark, sf):
    b = bars(spark, sf, "15min")
    for window in ("open60", "close90", "not_midday"):
        b = G.session(b, {}, window).drop("short_ok").withColumnRenamed("long_ok", window)
    b = G.session(b, {}, "not_midday", crypto=True)
    return b.select(
        "symbol", ntz(F.col("ts")).alias("ts"), "open60", "close90", "not_midday",
        F.col("long_ok").alias("crypto_not_midday"),
    )


COIN = "CASE WHEN symbol = 'click' THEN 'clickUSDT' ELSE symbol END AS symbol"
CLASS = "symbol LIKE '%USDT'"
LOCAL = f"CASE WHEN {CLASS} THEN ts ELSE CAST({ny('ts')} AS TIMESTAMP) END"


def mixed(df):
    """One tick symbol renamed to a coin, so the table holds both classes."""
    return df.withColumn("symbol", F.when(F.col("symbol") == "click", "clickUSDT").otherwise(F.col("symbol")))


@query(
    "session_mixed",
    sql(
        "n15m",
        f"m AS (SELECT * REPLACE ({COIN}) FROM n15m), l AS (SELECT *, {LOCAL} AS lt, {CLASS} AS coin FROM m), "
        "k AS (SELECT *, date_part('hour', lt) * 60 + date_part('minute', lt) AS mi FROM l)",
        "SELECT symbol, ts, CASE WHEN coin THEN mi < 240 ELSE mi - 570 < 60 END AS open60, CASE WHEN coin THEN mi >= 1200 ELSE mi - 570 >= 300 END AS close90, "
        "CASE WHEN coin THEN mi < 360 OR mi >= 1080 ELSE mi - 570 < 90 OR mi - 570 >= 300 END AS not_midday, NOT coin AND mi >= 945 AS late, "
        "NOT coin AND ts = max(ts) OVER (PARTITION BY symbol, CAST(lt AS DATE)) AS eod FROM k",
    ),
)
def session_mixed(spark, sf):
    """Session parts and end-of-session masks by the class of each row."""
    b = session_masks(mixed(bars(spark, sf, "15min")))
    for window in ("open60", "close90", "not_midday"):
        b = G.session(b, {}, window).drop("short_ok").withColumnRenamed("long_ok", window)
    return b.select("symbol", ntz(F.col("ts")).alias("ts"), "open60", "close90", "not_midday", "late", "eod")


@query(
    "gap_mixed",
    sql(
        "n1h",
        f"m AS (SELECT * REPLACE ({COIN}) FROM n1h), l AS (SELECT *, CAST({LOCAL} AS DATE) AS day FROM m), "
        "d AS (SELECT symbol, day, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM l GROUP BY 1, 2), "
        "g AS (SELECT symbol, day, o / lag(c) OVER (PARTITION BY symbol ORDER BY day) - 1 AS gap FROM d)",
        "SELECT symbol, ts, coalesce(abs(gap) >= 0.005 AND gap > 0, false) AS long_ok, coalesce(abs(gap) >= 0.005 AND gap < 0, false) AS short_ok FROM l JOIN g USING (symbol, day)",
    ),
)
def gap_mixed(spark, sf):
    return shown(G.gap(mixed(numbered(spark, sf, "1h")), {}, 0.5, "aligned"))


VIX = (
    "v AS (SELECT date_trunc('day', ts) AS day, avg(price) AS lvl FROM ticks GROUP BY 1), "
    f"x AS (SELECT symbol, ts, date_trunc('day', {ny('ts')}) AS day FROM n1h), "
    "j AS (SELECT x.symbol, x.ts, lvl FROM x ASOF LEFT JOIN v ON x.day > v.day)"
)


@query("vix_gate", sql("n1h", VIX, ok_sql("j", "lvl < 50", "lvl < 50")))
def vix_gate(spark, sf):
    """The market's daily level gates every symbol by its last earlier value."""
    daily = ticks(spark, sf).groupBy(F.to_date("ts").alias("date")).agg(F.avg("price").alias("close"))
    return shown(G.vix(numbered(spark, sf, "1h"), {"vix": daily}, "lt", 50.0))


@query(
    "event_gate",
    sql("n1h", DAYS, f"SELECT symbol, ts, NOT (isodow(day) = 5 AND day(day) <= 7) AS long_ok, NOT (isodow(day) = 5 AND day(day) <= 7) AS short_ok FROM d"),
)
def event_gate(spark, sf):
    return shown(G.event(numbered(spark, sf, "1h"), {}, "avoid"))


LEVEL_OK = ok_sql(
    "lm", "NOT coalesce(dist_ema21_4h BETWEEN -20 AND 20, false)",
    "NOT coalesce(dist_pdl BETWEEN 0 AND 500, false) AND NOT coalesce(dist_sma5_1d BETWEEN -10 AND 10, false)",
)


@query("level_gate", sql("n1h n1d n4h", LEVEL_SQL, LEVEL_OK))
def level_gate(spark, sf):
    return shown(
        G.level(
            numbered(spark, sf, "1h"), frames_of(spark, sf, ["1d", "4h"]),
            block_long=[("dist_ema21_4h", -20, 20)],
            block_short=[("dist_pdl", 0, 500), ("dist_sma5_1d", -10, 10)],
            levels=LEVELS,
        )
    )


RSI_J = (
    rsi_cte("r4", "n4h", 14)
    + ", j AS MATERIALIZED (SELECT b.symbol, b.ts, b.bar_no, rsi FROM n1h b ASOF LEFT JOIN (SELECT *, ts + INTERVAL 4 HOUR AS seen FROM r4) q "
    "ON b.symbol = q.symbol AND b.ts >= q.seen)"
)


@query(
    "rsi_gate",
    sql("n1h n4h", RSI_J, ok_sql("j", "rsi < 45 OR rsi > 55", "rsi < 40 OR rsi > 60")),
)
def rsi_gate(spark, sf):
    return shown(
        G.rsi(numbered(spark, sf, "1h"), frames_of(spark, sf, ["4h"]), "4h", 14, (45, 55), (40, 60), "outside")
    )


@query(
    "gated_entries",
    sql(
        "n1h n4h",
        band_flags("stddev_pop", 1.5),
        "z AS (" + fffd_sql() + ")",
        RSI_J,
        "ent AS (SELECT DISTINCT z.symbol, b.ts AS entry_ts, b.bar_no, z.dir FROM (SELECT *, ts + INTERVAL 1 HOUR AS seen FROM z) z "
        "ASOF JOIN n1h b ON z.symbol = b.symbol AND z.seen <= b.ts), "
        f"eod AS (SELECT symbol, bar_no, date_part('hour', {ny('ts')}) * 60 + date_part('minute', {ny('ts')}) >= 945 AS late, "
        f"ts = max(ts) OVER (PARTITION BY symbol, CAST({ny('ts')} AS DATE)) AS eod FROM n1h)",
        "SELECT ent.symbol, entry_ts, ent.dir FROM ent JOIN j USING (symbol, bar_no) JOIN eod USING (symbol, bar_no) "
        "WHERE (CASE WHEN ent.dir = 1 THEN rsi >= 35 AND rsi <= 100 ELSE rsi >= 0 AND rsi <= 65 END) AND NOT late AND NOT eod.eod",
    ),
)
def gated_entries(spark, sf):
    n = numbered(spark, sf, "1h")
    frames = frames_of(spark, sf, ["4h"])
    e = S.activate(S.fffd(n, 1.5).drop("bar_no"), n, "1h", {"bar_no": "entry_no", "ts": "entry_ts"})
    e = e.select("symbol", "entry_ts", "entry_no", "dir").distinct()
    e = G.apply_gate(e, n, frames, {"ind": "rsi", "tf": "4h", "long": (35, 100), "short": (0, 65)})
    e = G.block_session_end(e, session_masks(n))
    return e.select("symbol", ntz(F.col("entry_ts")).alias("entry_ts"), F.col("dir").cast("long").alias("dir"))
