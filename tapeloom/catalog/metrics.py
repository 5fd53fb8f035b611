"""Trade metrics and portfolio views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import COMPOUND, ny, query, rd, rsi_cte, sql
from tapeloom.catalog.indicators import LEVEL_SQL, LEVELS, frames_of
from tapeloom.catalog.outcomes import ENT, PCT, TIE, next_bar_entries, pct_trades
from tapeloom.functions.columns import add_tf, div, floor_ts, local, local_day, ntz, r
from tapeloom.operators import gates as G
from tapeloom.operators import indicators as I
from tapeloom.operators import metrics as M
from tapeloom.operators import portfolio as P
from tapeloom.operators.asof import align_setups
from tapeloom.operators.series import DAY, prefix_scan, time_bucket
from tapeloom.session import stage
from tapeloom.sources.tables import bars, numbered, table, trades

WINS = "coalesce(sum(CASE WHEN {r} > 0 THEN {r} END), 0)"
LOSS = "-coalesce(sum(CASE WHEN {r} < 0 THEN {r} END), 0)"


def pf_sql(ret: str = "ret", no_loss: str = "null") -> str:
    w, l = WINS.format(r=ret), f"({LOSS.format(r=ret)})"
    other = {"null": "NULL", "inf_or_zero": f"CASE WHEN {w} > 0 THEN 1e308 ELSE 0 END", "inf_or_null": f"CASE WHEN {w} > 0 THEN 1e308 END"}[no_loss]
    return f"CASE WHEN {l} > 0 THEN {w} / {l} ELSE {other} END"


DAYPNL = "dp AS (SELECT cfg, date_trunc('day', entry_ts) AS day, sum(ret * 1000) AS pnl FROM trades GROUP BY 1, 2)"


@query(
    "profit_factor",
    sql("trades", f"SELECT symbol, cfg, {rd(pf_sql())} AS pf_null, {rd(pf_sql(no_loss='inf_or_zero'))} AS pf_zero, "
        f"{rd(pf_sql(no_loss='inf_or_null'))} AS pf_inf FROM trades GROUP BY 1, 2"),
)
def profit_factor(spark, sf):
    ret = F.col("ret")
    return trades(spark, sf).groupBy("symbol", "cfg").agg(
        r(M.profit_factor(ret)).alias("pf_null"),
        r(M.profit_factor(ret, "inf_or_zero")).alias("pf_zero"),
        r(M.profit_factor(ret, "inf_or_null")).alias("pf_inf"),
    )


DD = (
    "cm AS (SELECT {k}, day, sum(pnl) OVER (PARTITION BY {k} ORDER BY day) AS cum FROM {src}), "
    "pk AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY {k} ORDER BY day)) AS peak FROM cm), "
    "dd AS (SELECT {k}, least(min(cum - peak), 0) AS max_drawdown FROM pk GROUP BY 1)"
)


@query(
    "trade_metrics",
    sql(
        "trades",
        "dp AS (SELECT symbol, date_trunc('day', entry_ts) AS day, sum(ret) AS pnl FROM trades GROUP BY 1, 2)",
        DD.format(k="symbol", src="dp"),
        "sh AS (SELECT symbol, avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(365) AS sharpe FROM dp GROUP BY 1)",
        f"SELECT symbol, count(*) AS n_trades, {rd('100.0 * count(*) FILTER (WHERE ret > 0) / count(*)', 1)} AS win_rate_pct, "
        f"{rd(pf_sql(), 3)} AS profit_factor, {rd('100 * avg(ret)', 3)} AS avg_trade_pct, {rd('100 * median(ret)', 3)} AS median_trade_pct, "
        f"{rd(COMPOUND, 2)} AS total_return_pct, {rd('100 * any_value(max_drawdown)', 2)} AS max_dd_pct, "
        f"{rd('any_value(sharpe)', 2)} AS sharpe FROM trades JOIN dd USING (symbol) JOIN sh USING (symbol) GROUP BY 1",
    ),
)
def trade_metrics(spark, sf):
    t = trades(spark, sf)
    ret = F.col("ret")
    daily = M.daily_sums(t, ["symbol"], ret)
    base = t.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_trades"),
        r(M.win_rate_pct(ret), 1).alias("win_rate_pct"),
        r(M.profit_factor(ret), 3).alias("profit_factor"),
        r(F.avg(ret) * 100, 3).alias("avg_trade_pct"),
        r(M.compounded_pct(ret), 2).alias("total_return_pct"),
    )
    median = M.quantiles(t, ["symbol"], "ret", {"m": 0.5}).select("symbol", r(F.col("m") * 100, 3).alias("median_trade_pct"))
    dd = M.max_drawdown(daily, ["symbol"]).select("symbol", r(F.col("max_drawdown") * 100, 2).alias("max_dd_pct"))
    sharpe = daily.groupBy("symbol").agg(r(M.sharpe(F.col("pnl")) * F.sqrt(F.lit(365.0)), 2).alias("sharpe"))
    return base.join(median, "symbol").join(dd, "symbol").join(sharpe, "symbol")


@query("max_drawdown", sql("trades", DAYPNL, DD.format(k="cfg", src="dp"), f"SELECT cfg, {rd('max_drawdown', 4)} AS max_drawdown FROM dd"))
def max_drawdown(spark, sf):
    daily = M.daily_sums(trades(spark, sf), ["cfg"], F.col("ret") * 1000)
    return M.max_drawdown(daily, ["cfg"]).select("cfg", r(F.col("max_drawdown"), 4).alias("max_drawdown"))


@query(
    "trade_sharpe",
    sql("trades", f"SELECT symbol, cfg, CASE WHEN count(*) >= 2 THEN {rd('avg(ret) / nullif(stddev_samp(ret), 0)', 3)} END AS sharpe FROM trades GROUP BY 1, 2"),
)
def trade_sharpe(spark, sf):
    return trades(spark, sf).groupBy("symbol", "cfg").agg(r(M.sharpe(F.col("ret")), 3).alias("sharpe"))


def oos_columns(ret):
    return [
        F.count(F.lit(1)).alias("oos_trades"),
        r(M.profit_factor(ret), 3).alias("oos_pf"),
        r(M.win_rate_pct(ret), 1).alias("oos_win_rate_pct"),
        r(F.avg(ret) * 100, 3).alias("oos_avg_trade_pct"),
        r(M.compounded_pct(ret), 2).alias("oos_return_pct"),
    ]


@query(
    "monthly_pnl",
    sql("trades",
        "m AS (SELECT cfg, strftime(entry_ts, '%Y-%m') AS month, sum(ret * 1000) AS pnl, count(*) AS n, "
        f"count(*) FILTER (WHERE ret > 0) AS wins, {pf_sql()} AS pf FROM trades GROUP BY 1, 2)",
        f"SELECT cfg, month, {rd('pnl', 4)} AS pnl, n, wins, {rd('pf')} AS profit_factor, "
        "count(*) FILTER (WHERE pnl > 0) OVER (PARTITION BY cfg) AS positive_months, "
        f"{rd('min(pnl) OVER (PARTITION BY cfg)', 4)} AS worst_month FROM m"),
)
def monthly_pnl(spark, sf):
    """Monthly consistency per setup; the second step sees one row per month."""
    m = trades(spark, sf).groupBy("cfg", F.date_format("entry_ts", "yyyy-MM").alias("month")).agg(
        F.sum(F.col("ret") * 1000).alias("pnl"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ret") > 0).alias("wins"),
        r(M.profit_factor(F.col("ret"))).alias("profit_factor"),
    )
    total = m.groupBy("cfg").agg(F.count_if(F.col("pnl") > 0).alias("positive_months"), r(F.min("pnl"), 4).alias("worst_month"))
    return m.withColumn("pnl", r(F.col("pnl"), 4)).join(total, "cfg")


@query("daily_pnl_dense", sql("trades", DAYPNL,
       f"SELECT day, c.cfg, {rd('coalesce(pnl, 0)', 4)} AS pnl FROM (SELECT DISTINCT day FROM dp) CROSS JOIN (SELECT DISTINCT cfg FROM dp) c "
       "LEFT JOIN dp USING (day, cfg)"))
def daily_pnl_dense(spark, sf):
    d = P.dense_daily(trades(spark, sf), "cfg", F.col("ret") * 1000)
    return d.select(ntz(F.col("day")).alias("day"), "cfg", r(F.col("pnl"), 4).alias("pnl"))


@query("pnl_corr", sql("trades", DAYPNL,
       "g AS (SELECT day, c.cfg, coalesce(pnl, 0) AS pnl FROM (SELECT DISTINCT day FROM dp) CROSS JOIN (SELECT DISTINCT cfg FROM dp) c LEFT JOIN dp USING (day, cfg))",
       f"SELECT a.cfg AS setup_a, b.cfg AS setup_b, {rd('corr(a.pnl, b.pnl)')} AS corr FROM g a JOIN g b ON a.day = b.day AND a.cfg < b.cfg GROUP BY 1, 2"))
def pnl_corr(spark, sf):
    c = P.correlations(trades(spark, sf), "cfg", F.col("ret") * 1000)
    return c.select("setup_a", "setup_b", r(F.col("corr")).alias("corr"))


@query(
    "concentration",
    sql("trades", "p AS (SELECT cfg, ret * qty AS pnl, row_number() OVER (PARTITION BY cfg ORDER BY ret * qty DESC) AS rn FROM trades WHERE ret > 0)",
        f"SELECT cfg, {rd('sum(CASE WHEN rn <= 10 THEN pnl END) / sum(pnl)')} AS top_share FROM p GROUP BY 1"),
)
def concentration(spark, sf):
    t = trades(spark, sf).withColumn("pnl", F.col("ret") * F.col("qty"))
    return P.top_share(t, ["cfg"], "pnl").select("cfg", r(F.col("top_share")).alias("top_share"))


LONG = "lt AS (SELECT *, entry_ts + INTERVAL 1 DAY * CAST(qty AS INTEGER) AS xts FROM trades)"


def lasting(spark, sf):
    """Trades that stay open for qty days."""
    return trades(spark, sf).withColumn(
        "exit_ts", F.timestamp_micros(F.unix_micros("entry_ts") + F.col("qty").cast("long") * F.lit(86_400_000_000))
    )


OPEN = (
    "ch AS (SELECT {k} AS k, entry_ts AS ts, 1 AS n, qty AS cap, 1 AS e FROM lt UNION ALL SELECT {k}, xts, -1, -qty, 0 FROM lt), "
    "c2 AS (SELECT k, ts, sum(n) AS n, sum(cap) AS cap, sum(e) AS e FROM ch GROUP BY 1, 2), "
    "run AS MATERIALIZED (SELECT k, ts, e, sum(n) OVER (PARTITION BY k ORDER BY ts) AS open_count, sum(cap) OVER (PARTITION BY k ORDER BY ts) AS capital FROM c2)"
)


@query("concurrency", sql("trades", LONG, OPEN.format(k="cfg"),
       "SELECT k AS cfg, ts, CAST(open_count AS BIGINT) AS open_count, capital, CAST(e AS BIGINT) AS entered FROM run WHERE e > 0"))
def concurrency(spark, sf):
    p = P.open_positions(lasting(spark, sf), ["cfg"], F.col("qty"))
    return p.select("cfg", ntz(F.col("ts")).alias("ts"), "open_count", "capital", "entered")


SECTORS = "sec AS (SELECT s_suppkey AS symbol, coalesce(n_name, 'Other') AS sector FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey < 20)"


def sectors(spark, sf):
    """Supplier nations as sectors; unmatched symbols get the default."""
    n = table(spark, sf, "nation").where(F.col("n_nationkey") < 20)
    s = table(spark, sf, "supplier")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select(
        F.col("s_suppkey").alias("symbol"), F.coalesce("n_name", F.lit("Other")).alias("sector")
    )


@query(
    "peak_sector_mix",
    sql("trades", LONG, OPEN.format(k="0"), SECTORS,
        "pk AS (SELECT ts FROM run WHERE e > 0 ORDER BY capital DESC, ts LIMIT 1)",
        "SELECT sector, count(*) AS open_count FROM lt JOIN sec USING (symbol) WHERE entry_ts <= (SELECT ts FROM pk) AND xts > (SELECT ts FROM pk) GROUP BY 1"),
)
def peak_sector_mix(spark, sf):
    return P.peak_mix(lasting(spark, sf).join(sectors(spark, sf), "symbol"), F.col("qty"), "sector")


@query(
    "sector_hit_rate",
    sql("trades", SECTORS, f"p AS (SELECT symbol, {pf_sql()} AS pf FROM trades GROUP BY 1)",
        f"SELECT sector, count(*) AS n, count(*) FILTER (WHERE pf > 1) AS hits, {rd('100.0 * count(*) FILTER (WHERE pf > 1) / count(*)')} AS hit_rate_pct "
        "FROM p JOIN sec USING (symbol) GROUP BY 1"),
)
def sector_hit_rate(spark, sf):
    p = trades(spark, sf).groupBy("symbol").agg(M.profit_factor(F.col("ret")).alias("pf"))
    return p.join(sectors(spark, sf), "symbol").groupBy("sector").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("pf") > 1).alias("hits"),
        r(F.count_if(F.col("pf") > 1) * 100.0 / F.count(F.lit(1))).alias("hit_rate_pct"),
    )


@query(
    "weekly_journal",
    sql("trades", LONG, OPEN.format(k="0"),
        f"w AS (SELECT isoyear({ny('entry_ts')}) AS iso_year, week({ny('entry_ts')}) AS iso_week, count(*) AS trades, sum(ret * 1000) AS pnl, "
        "count(*) FILTER (WHERE ret > 0) AS wins FROM lt GROUP BY 1, 2), "
        f"p AS (SELECT isoyear({ny('ts')}) AS iso_year, week({ny('ts')}) AS iso_week, max(open_count) AS max_open, max(capital) AS peak_capital "
        "FROM run WHERE e > 0 GROUP BY 1, 2), "
        "j AS (SELECT *, 100000 + sum(pnl) OVER (ORDER BY iso_year, iso_week) AS end_balance FROM w JOIN p USING (iso_year, iso_week))",
        f"SELECT iso_year, iso_week, trades, wins, {rd('pnl', 4)} AS pnl, CAST(max_open AS BIGINT) AS max_open, peak_capital, "
        f"{rd('end_balance - pnl', 4)} AS start_balance, {rd('end_balance', 4)} AS end_balance, {rd('100 * pnl / (end_balance - pnl)')} AS ret_pct FROM j"),
)
def weekly_journal(spark, sf):
    w = P.weekly_ledger(lasting(spark, sf), F.col("ret") * 1000, F.col("qty"), 100_000.0)
    return w.select(
        "iso_year", "iso_week", "trades", "wins", r(F.col("pnl"), 4).alias("pnl"), "max_open", "peak_capital",
        r(F.col("start_balance"), 4).alias("start_balance"), r(F.col("end_balance"), 4).alias("end_balance"),
        r(F.col("ret_pct")).alias("ret_pct"),
    )


@query(
    "pnl_summary",
    sql("trades", "SELECT cfg, count(*) AS n, "
        f"{rd('sum(ret * 1000)', 4)} AS pnl, {rd('100.0 * count(*) FILTER (WHERE ret > 0) / count(*)')} AS win_rate_pct FROM trades "
        "WHERE exit_ts >= (SELECT max(exit_ts) FROM trades) - INTERVAL 90 DAY GROUP BY 1"),
)
def pnl_summary(spark, sf):
    t = trades(spark, sf)
    last = t.agg(F.max("exit_ts")).scalar()
    recent = t.where(F.col("exit_ts") >= add_tf(last, "1d", -90))
    return recent.groupBy("cfg").agg(
        F.count(F.lit(1)).alias("n"),
        r(F.sum(F.col("ret") * 1000), 4).alias("pnl"),
        r(M.win_rate_pct(F.col("ret"))).alias("win_rate_pct"),
    )


RECENT_ORDER = "exit_ts DESC, order_id DESC, line_no DESC, part_id DESC, qty DESC, ret DESC, cfg DESC"


@query("recent_trades", sql("trades", f"SELECT exit_ts, order_id, line_no, part_id, ret FROM trades ORDER BY {RECENT_ORDER} LIMIT 15"))
def recent_trades(spark, sf):
    """Newest first, the fifteen the ledger page shows."""
    newest = [F.desc(c.split()[0]) for c in RECENT_ORDER.split(", ")]
    t = trades(spark, sf).orderBy(*newest).limit(15)
    return t.select(ntz(F.col("exit_ts")).alias("exit_ts"), "order_id", "line_no", "part_id", "ret")


LEDGER_TIE = ", ".join(["entry_ts", *TIE])
LEDGER_WIN = f"(PARTITION BY symbol ORDER BY {LEDGER_TIE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "compound_ledger",
    sql("trades", "SELECT symbol, entry_ts, order_id, line_no, part_id, ret, "
        f"{rd(f'CASE WHEN coalesce(min(ret) OVER {LEDGER_WIN}, 0) > -1 THEN coalesce(sum(ln(CASE WHEN ret > -1 THEN 1 + ret END)) OVER {LEDGER_WIN}, 0) END')} AS log_stake FROM trades"),
)
def compound_ledger(spark, sf):
    """Stake before each trade when every result is reinvested, in log form; NULL once all is lost."""
    t = prefix_scan(
        trades(spark, sf), ["symbol"], ["entry_ts", *TIE], time_bucket("entry_ts", 30 * DAY),
        {"log_stake": ("sum", M.log_growth(F.col("ret"))), "lost": ("sum", M.ruined(F.col("ret")))}, inclusive=False,
    )
    return t.select(
        "symbol", ntz(F.col("entry_ts")).alias("entry_ts"), "order_id", "line_no", "part_id", "ret",
        r(F.when(F.coalesce("lost", F.lit(0)) == 0, F.coalesce("log_stake", F.lit(0.0)))).alias("log_stake"),
    )


@query(
    "paper_daily",
    sql("trades", LONG, f"SELECT CAST(CAST({ny('xts')} AS DATE) AS VARCHAR) AS day, count(*) AS closed, count(*) FILTER (WHERE ret > 0) AS wins, "
        f"{rd('sum(ret * 1000)', 4)} AS pnl FROM lt GROUP BY 1"),
)
def paper_daily(spark, sf):
    t = lasting(spark, sf)
    return t.groupBy(local_day(F.col("exit_ts")).cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("closed"),
        F.count_if(F.col("ret") > 0).alias("wins"),
        r(F.sum(F.col("ret") * 1000), 4).alias("pnl"),
    )


@query(
    "unrealized_pnl",
    sql("n1h", ENT, "lp AS (SELECT symbol, arg_max(close, ts) AS last FROM n1h GROUP BY 1)",
        f"SELECT symbol, entry_ts, CAST(dir AS BIGINT) AS dir, {rd('1000 * dir * (last / price - 1)', 4)} AS pnl_usd FROM ent JOIN lp USING (symbol)"),
)
def unrealized_pnl(spark, sf):
    n = numbered(spark, sf, "1h")
    last = n.groupBy("symbol").agg(F.max_by("close", "ts").alias("last"))
    e = next_bar_entries(n).join(last, "symbol")
    pnl = 1000 * F.col("dir") * (div(F.col("last"), F.col("price")) - 1)
    return e.select("symbol", ntz(F.col("entry_ts")).alias("entry_ts"), F.col("dir").cast("long").alias("dir"), r(pnl, 4).alias("pnl_usd"))


# ---------------------------------------------------------------- by indicator at entry

RSI_AT = (
    rsi_cte("r4", "n4h", 14) + ", " + rsi_cte("r2", "n2h", 14)
    + ", rt AS MATERIALIZED (SELECT tr.*, a.rsi AS rsi_4h, b.rsi AS rsi_2h FROM tr "
    "ASOF LEFT JOIN (SELECT *, ts + INTERVAL 4 HOUR AS seen FROM r4) a ON tr.symbol = a.symbol AND tr.entry_ts >= a.seen "
    "ASOF LEFT JOIN (SELECT *, ts + INTERVAL 2 HOUR AS seen FROM r2) b ON tr.symbol = b.symbol AND tr.entry_ts >= b.seen WHERE exit_ts IS NOT NULL)"
)


def trades_with_rsi(spark, sf):
    t, n = pct_trades(spark, sf)
    closed = t.where(F.col("exit_ts").isNotNull()).withColumn("ts", F.col("entry_ts"))
    f = frames_of(spark, sf, ["4h", "2h"])
    sides = [(I.rsi(f[tf]), tf, {"rsi": f"rsi_{tf}"}) for tf in ("4h", "2h")]
    return align_setups(closed, sides)


BINS = "CASE WHEN v > 0 AND v <= 30 THEN 0 WHEN v > 30 AND v <= 40 THEN 1 WHEN v > 40 AND v <= 50 THEN 2 WHEN v > 50 AND v <= 60 THEN 3 WHEN v > 60 AND v <= 70 THEN 4 WHEN v > 70 AND v <= 100 THEN 5 END"
GROUP_COLS = f"count(*) AS n, {rd('100.0 * count(*) FILTER (WHERE ret > 0) / count(*)', 1)} AS win_rate, {rd(pf_sql(no_loss='inf_or_zero'), 2)} AS pf, {rd('100 * avg(ret)', 3)} AS avg_ret_pct"


def group_columns():
    ret = F.col("ret")
    return [
        F.count(F.lit(1)).alias("n"),
        r(M.win_rate_pct(ret), 1).alias("win_rate"),
        r(M.profit_factor(ret, "inf_or_zero"), 2).alias("pf"),
        r(F.avg(ret) * 100, 3).alias("avg_ret_pct"),
    ]


@query(
    "rsi_buckets",
    sql("n1h n4h n2h", ENT, PCT, RSI_AT,
        "u AS (SELECT 'rsi_4h' AS feature, rsi_4h AS v, ret FROM rt UNION ALL SELECT 'rsi_2h', rsi_2h, ret FROM rt)",
        f"SELECT feature, CAST({BINS} AS BIGINT) AS bucket, {GROUP_COLS} FROM u WHERE {BINS} IS NOT NULL GROUP BY 1, 2"),
)
def rsi_buckets(spark, sf):
    t = trades_with_rsi(spark, sf).select(
        "ret", F.expr("stack(2, 'rsi_4h', rsi_4h, 'rsi_2h', rsi_2h) as (feature, v)")
    )
    t = t.withColumn("bucket", M.right_closed_bin(F.col("v"), [0, 30, 40, 50, 60, 70, 100]))
    return t.where(F.col("bucket").isNotNull()).groupBy("feature", "bucket").agg(*group_columns())


@query(
    "rsi_extremes",
    sql("n1h n4h n2h", ENT, PCT, RSI_AT,
        "u AS (SELECT 'rsi_4h' AS feature, rsi_4h AS v, ret, dir FROM rt UNION ALL SELECT 'rsi_2h', rsi_2h, ret, dir FROM rt)",
        f"SELECT feature, CASE WHEN dir = 1 THEN 'long' ELSE 'short' END AS side, {GROUP_COLS} FROM u "
        "WHERE (dir = 1 AND v < 45) OR (dir = -1 AND v > 55) GROUP BY 1, 2"),
)
def rsi_extremes(spark, sf):
    t = trades_with_rsi(spark, sf).select(
        "ret", "dir", F.expr("stack(2, 'rsi_4h', rsi_4h, 'rsi_2h', rsi_2h) as (feature, v)")
    )
    far = ((F.col("dir") == 1) & (F.col("v") < 45)) | ((F.col("dir") == -1) & (F.col("v") > 55))
    side = F.when(F.col("dir") == 1, "long").otherwise("short").alias("side")
    return t.where(far).groupBy("feature", side).agg(*group_columns())


BANDS = "CASE WHEN v <= -30 THEN 0 WHEN v <= -10 THEN 1 WHEN v <= 0 THEN 2 WHEN v <= 10 THEN 3 WHEN v <= 30 THEN 4 WHEN v > 30 THEN 5 END"


@query(
    "level_bands",
    sql("n1h n1d n4h", ENT, PCT, LEVEL_SQL,
        "lt AS MATERIALIZED (SELECT tr.*, dist_ema21_4h, dist_pdh, slope_sma5_1d FROM tr JOIN lm ON lm.symbol = tr.symbol AND lm.bar_no = tr.entry_no WHERE exit_ts IS NOT NULL), "
        "u AS (SELECT 'dist_ema21_4h' AS feature, dist_ema21_4h AS v, ret, dir FROM lt UNION ALL SELECT 'dist_pdh', dist_pdh, ret, dir FROM lt), "
        "u2 AS (SELECT *, count(*) OVER (PARTITION BY feature, dir) AS side_n FROM u), "
        f"bands AS (SELECT feature, CAST(dir AS BIGINT) AS dir, CAST({BANDS} AS BIGINT) AS band, {GROUP_COLS}, any_value(side_n) >= 20 AND count(*) >= 5 AS enough FROM u2 WHERE v IS NOT NULL GROUP BY 1, 2, 3), "
        f"hyp AS (SELECT 'long above rising average' AS feature, CAST(1 AS BIGINT) AS dir, CAST(NULL AS BIGINT) AS band, {GROUP_COLS}, count(*) >= 8 AS enough FROM lt WHERE dir = 1 AND dist_ema21_4h > 0 AND slope_sma5_1d > 0 HAVING count(*) > 0)",
        "SELECT * FROM bands UNION ALL SELECT * FROM hyp"),
)
def level_bands(spark, sf):
    """Results by distance to a level, per side; ``enough`` marks the groups that the report shows."""
    t, n = pct_trades(spark, sf)
    lm = G.level_matrix(n, frames_of(spark, sf, ["1d", "4h"]), LEVELS).select(
        "symbol", F.col("bar_no").alias("entry_no"), "dist_ema21_4h", "dist_pdh", "slope_sma5_1d"
    )
    lt = stage(t.where(F.col("exit_ts").isNotNull()).join(lm, ["symbol", "entry_no"]), "level-trades")
    u = lt.select("ret", "dir", F.expr("stack(2, 'dist_ema21_4h', dist_ema21_4h, 'dist_pdh', dist_pdh) as (feature, v)"))
    sides = u.groupBy("feature", "dir").agg(F.count(F.lit(1)).alias("side_n"))
    inf = float("inf")
    banded = u.join(sides, ["feature", "dir"]).withColumn("band", M.right_closed_bin(F.col("v"), [-inf, -30, -10, 0, 10, 30, inf]))
    bands = (
        banded.where(F.col("band").isNotNull())
        .groupBy("feature", F.col("dir").cast("long").alias("dir"), "band")
        .agg(*group_columns(), F.max("side_n").alias("side_n"))
        .withColumn("enough", F.expr("side_n >= 20 and n >= 5"))
        .drop("side_n")
    )
    hyp = (
        lt.where((F.col("dir") == 1) & (F.col("dist_ema21_4h") > 0) & (F.col("slope_sma5_1d") > 0))
        .groupBy(F.lit("long above rising average").alias("feature"), F.col("dir").cast("long").alias("dir"), F.lit(None).cast("long").alias("band"))
        .agg(*group_columns())
        .withColumn("enough", F.expr("n >= 8"))
    )
    return bands.unionByName(hyp)
