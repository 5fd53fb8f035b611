"""Bar building, session handling and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import ny, query, rd, secs, sql, utc_from_ny
from tapeloom.functions.columns import NEW_YORK, add_tf, asset_class, div, local, local_day, ntz, r
from tapeloom.operators import bars as B
from tapeloom.operators import quality as Q
from tapeloom.operators.series import DAY
from tapeloom.sources.tables import bars, numbered, ticks

OHLCV = ["symbol", "open", "high", "low", "close", "volume"]


def show(df, *extra, cols=OHLCV):
    return df.select(ntz(F.col("ts")).alias("ts"), *cols, *extra)


@query("tick_bars", sql("b15m", "SELECT * FROM b15m"))
def tick_bars(spark, sf):
    return show(bars(spark, sf, "15min"), "trades")


@query(
    "bars_1h",
    sql(
        "b15m",
        f"SELECT symbol, time_bucket({secs('1h')}, ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, "
        "min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b15m GROUP BY 1, 2",
    ),
)
def bars_1h(spark, sf):
    return show(B.resample(bars(spark, sf, "15min"), "1h"))


SESSION_2H = (
    "s AS (SELECT *, " + utc_from_ny(f"time_bucket({secs('2h')}, {ny('ts')}, TIMESTAMP '2000-01-01 01:30:00')")
    + " AS label FROM b15m)"
)
SESSION_1D = (
    "s AS (SELECT *, " + utc_from_ny(f"(date_trunc('day', {ny('ts')}) + INTERVAL 570 MINUTE)") + " AS label FROM b15m)"
)
SESSION_OUT = (
    "SELECT symbol, label AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, "
    "arg_max(close, ts) AS close, sum(volume) AS volume FROM s GROUP BY 1, 2"
)


@query("bars_session", sql("b15m", SESSION_2H, SESSION_OUT))
def bars_session(spark, sf):
    return show(B.resample_session(bars(spark, sf, "15min"), "2h"))


@query("bars_session_daily", sql("b15m", SESSION_1D, SESSION_OUT))
def bars_session_daily(spark, sf):
    return show(B.resample_session(bars(spark, sf, "15min"), "1d"))


VWAP_15 = (
    f"v AS (SELECT symbol, time_bucket({secs('15min')}, ts) AS ts, CAST(sum(size) AS DOUBLE) AS volume, "
    "sum(price * size) / nullif(sum(size), 0) AS vwap FROM ticks GROUP BY 1, 2)"
)


def bars_with_vwap(spark, sf):
    t = ticks(spark, sf)
    return t.groupBy("symbol", B.floor_ts(F.col("ts"), 900).alias("ts")).agg(
        F.sum("size").cast("double").alias("volume"),
        div(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"),
    )


@query(
    "bars_vwap",
    sql(
        "ticks",
        VWAP_15,
        f"SELECT symbol, time_bucket({secs('4h')}, ts) AS ts, sum(volume) AS volume, "
        f"{rd('sum(volume * vwap) / nullif(sum(volume), 0)')} AS vwap FROM v GROUP BY 1, 2",
    ),
)
def bars_vwap(spark, sf):
    out = B.resample_vwap(bars_with_vwap(spark, sf), "4h")
    return out.select("symbol", ntz(F.col("ts")).alias("ts"), "volume", r(F.col("vwap")).alias("vwap"))


@query(
    "bronze_vwap",
    sql(
        "ticks",
        f"SELECT symbol, time_bucket({secs('1min')}, ts) AS ts, 'tape' AS source, "
        f"{rd('sum(price * size) / nullif(sum(size), 0)')} AS vwap FROM ticks GROUP BY 1, 2",
    ),
)
def bronze_vwap(spark, sf):
    t = ticks(spark, sf).withColumn("quote", F.col("price") * F.col("size"))
    per = t.groupBy("symbol", B.floor_ts(F.col("ts"), 60).alias("ts")).agg(
        F.sum("quote").alias("quote_volume"), F.sum("size").alias("volume")
    )
    return per.select(
        "symbol",
        ntz(F.col("ts")).alias("ts"),
        F.lit("tape").alias("source"),
        r(div(F.col("quote_volume"), F.col("volume"))).alias("vwap"),
    )


@query(
    "daily_curve",
    sql(
        "b15m",
        "d AS (SELECT symbol, date_trunc('day', ts) AS ts, arg_max(close, ts) AS close FROM b15m GROUP BY 1, 2), "
        "f AS (SELECT symbol, arg_min(close, ts) AS base FROM b15m GROUP BY 1)",
        f"SELECT symbol, ts, close, {rd('close / base')} AS curve FROM d JOIN f USING (symbol)",
    ),
)
def daily_curve(spark, sf):
    b = bars(spark, sf, "15min")
    base = b.groupBy("symbol").agg(F.min_by("close", "ts").alias("base"))
    return (
        B.daily_last(b, "close", ["symbol"])
        .join(base, "symbol")
        .select(
            "symbol", ntz(F.col("ts")).alias("ts"), "close", r(div(F.col("close"), F.col("base"))).alias("curve")
        )
    )


CALENDAR = (
    f"cal AS (SELECT DISTINCT CAST({ny('ts')} AS DATE) AS day FROM b15m WHERE isodow({ny('ts')}) < 6), "
    "c2 AS (SELECT day, " + utc_from_ny("(CAST(day AS TIMESTAMP) + INTERVAL 570 MINUTE)") + " AS open_utc, "
    + utc_from_ny("(CAST(day AS TIMESTAMP) + CASE WHEN isodow(day) = 5 THEN INTERVAL 780 MINUTE ELSE INTERVAL 960 MINUTE END)")
    + " AS close_utc FROM cal)"
)


def derived_calendar(b):
    """Weekdays seen in the data; Fridays close at 13:00 like a half-day."""
    day = F.col("day").cast("timestamp")
    minutes = F.when(F.weekday("day") == 4, 780).otherwise(960)
    at = lambda m: F.to_utc_timestamp(F.timestamp_micros(F.unix_micros(day) + m.cast("long") * F.lit(60_000_000)), NEW_YORK)
    return (
        b.select(local_day(F.col("ts")).alias("day"))
        .distinct()
        .where(F.weekday("day") < 5)
        .select("day", at(F.lit(570)).alias("open_utc"), at(minutes).alias("close_utc"))
    )


@query(
    "session_tag",
    sql(
        "b15m",
        CALENDAR,
        "SELECT symbol, ts, CASE WHEN open_utc IS NULL THEN 'closed' WHEN ts < open_utc THEN 'premarket' "
        "WHEN ts >= close_utc THEN 'postmarket' ELSE 'regular' END AS session "
        f"FROM b15m LEFT JOIN c2 ON c2.day = CAST({ny('ts')} AS DATE)",
    ),
)
def session_tag(spark, sf):
    b = bars(spark, sf, "15min")
    return show(B.tag_session(b, derived_calendar(b)), "session", cols=["symbol"])


RTH = f"(date_part('hour', {ny('ts')}) * 60 + date_part('minute', {ny('ts')}))"


@query("rth_filter", sql("b15m", f"SELECT * FROM b15m WHERE {RTH} >= 570 AND {RTH} < 960 AND isodow({ny('ts')}) < 6"))
def rth_filter(spark, sf):
    return show(B.rth(bars(spark, sf, "15min")), "trades")


@query(
    "eod_masks",
    sql(
        "b15m",
        f"SELECT symbol, ts, {RTH} >= 945 AS late, coalesce(CAST({ny('ts')} AS DATE) <> "
        f"lead(CAST({ny('ts')} AS DATE)) OVER (PARTITION BY symbol ORDER BY ts), true) AS eod FROM b15m",
    ),
)
def eod_masks(spark, sf):
    return show(B.session_masks(bars(spark, sf, "15min")), "late", "eod", cols=["symbol"])


@query(
    "completed_only",
    sql("b1h", "SELECT symbol, ts, close FROM b1h WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks)"),
)
def completed_only(spark, sf):
    now = ticks(spark, sf).agg(F.max("ts")).scalar()
    return show(B.completed(bars(spark, sf, "1h"), "1h", now), cols=["symbol", "close"])


@query(
    "recent_window",
    sql(
        "n1h",
        "m AS (SELECT symbol, max(ts) AS last_ts, max(bar_no) AS last_no FROM n1h GROUP BY 1)",
        "SELECT symbol, ts, close, bar_no > last_no - 20 AS in_tail FROM n1h JOIN m USING (symbol) "
        "WHERE ts >= last_ts - INTERVAL 7 DAY",
    ),
)
def recent_window(spark, sf):
    n = numbered(spark, sf, "1h")
    last = n.groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.max("bar_no").alias("last_no"))
    out = n.join(last, "symbol").where(F.col("ts") >= add_tf(F.col("last_ts"), "1d", -7))
    return show(out, "close", (F.col("bar_no") > F.col("last_no") - 20).alias("in_tail"), cols=["symbol"])


@query(
    "asset_class",
    sql(
        "ticks",
        "SELECT symbol || CASE WHEN seq % 2 = 0 THEN 'USDT' ELSE '' END AS ticker, "
        "CASE WHEN seq % 2 = 0 THEN 'crypto' ELSE 'stock' END AS asset_class, count(*) AS n FROM ticks GROUP BY 1, 2",
    ),
)
def asset_class_query(spark, sf):
    tickers = ticks(spark, sf).select(
        F.concat("symbol", F.when(F.col("seq") % 2 == 0, "USDT").otherwise("")).alias("ticker")
    )
    return tickers.groupBy("ticker", asset_class(F.col("ticker")).alias("asset_class")).agg(
        F.count(F.lit(1)).alias("n")
    )


# ---------------------------------------------------------------- quality

DIRTY = (
    "d AS (SELECT symbol, ts, open, high, CASE WHEN trades % 7 = 0 THEN close + 1 ELSE low END AS low, close, "
    "CASE WHEN trades % 5 = 0 THEN -volume ELSE volume END AS volume, trades FROM b15m)"
)
BAD = "(low > least(open, close) OR high < greatest(open, close) OR low <= 0 OR volume < 0)"


def dirty(spark, sf):
    return (
        bars(spark, sf, "15min")
        .withColumn("low", F.when(F.col("trades") % 7 == 0, F.col("close") + 1).otherwise(F.col("low")))
        .withColumn("volume", F.when(F.col("trades") % 5 == 0, -F.col("volume")).otherwise(F.col("volume")))
    )


@query(
    "ohlc_violations",
    sql("b15m", DIRTY, f"SELECT symbol, count(*) FILTER (WHERE {BAD}) AS ohlc_violations FROM d GROUP BY 1"),
)
def ohlc_violations(spark, sf):
    return Q.ohlc_violations(dirty(spark, sf))


RAW = (
    "raw AS (SELECT symbol, ts, close * (1 + (trades % 4) / 1000.0::DOUBLE) AS close FROM b15m), "
    "adj AS (SELECT d.symbol, max(abs(d.close / nullif(raw.close, 0) - 1) * 100) AS max_adj_ratio_pct "
    "FROM d JOIN raw USING (symbol, ts) GROUP BY 1)"
)


def raw_twin(b):
    return b.withColumn("close", F.col("close") * (1 + (F.col("trades") % 4) / 1000))


@query("adj_ratio", sql("b15m", DIRTY, RAW, f"SELECT symbol, {rd('max_adj_ratio_pct')} AS max_adj_ratio_pct FROM adj"))
def adj_ratio(spark, sf):
    b = dirty(spark, sf)
    return Q.adjustment_gap(b, raw_twin(b)).select("symbol", r(F.col("max_adj_ratio_pct")).alias("max_adj_ratio_pct"))


@query(
    "quality_report",
    sql(
        "b15m",
        DIRTY,
        RAW,
        "dup AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE trades >= 3), "
        "p AS (SELECT symbol, count(*) AS rows, count(DISTINCT ts) AS u, "
        f"count(DISTINCT date_trunc('day', ts)) AS days, count(*) FILTER (WHERE {BAD}) AS bad FROM dup GROUP BY 1)",
        f"SELECT symbol, rows, {rd('u * 100.0 / (days * 96)', 2)} AS coverage_pct, bad AS ohlc_violations, "
        f"rows - u AS dup_ts, {rd('max_adj_ratio_pct', 3)} AS max_adj_ratio_pct FROM p LEFT JOIN adj USING (symbol)",
    ),
)
def quality_report(spark, sf):
    b = dirty(spark, sf)
    twice = b.unionByName(b.where(F.col("trades") >= 3))
    out = Q.quality_report(twice, raw_twin(b), 96)
    return out.withColumns(
        {
            "coverage_pct": r(F.col("coverage_pct"), 2),
            "max_adj_ratio_pct": r(F.col("max_adj_ratio_pct"), 3),
        }
    )


@query(
    "outlier_wick",
    sql(
        "n15m",
        "w AS (SELECT *, high - low AS bar_range, CASE WHEN bar_no >= 100 THEN quantile_cont(high - low, 0.5) OVER "
        "(PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) END AS median_range FROM n15m)",
        f"SELECT symbol, ts, {rd('bar_range')} AS bar_range, {rd('median_range')} AS median_range FROM w "
        "WHERE bar_range > 20 * median_range",
    ),
)
def outlier_wick(spark, sf):
    out = Q.outlier_wicks(numbered(spark, sf, "15min"))
    return show(
        out, r(F.col("bar_range")).alias("bar_range"), r(F.col("median_range")).alias("median_range"), cols=["symbol"]
    )


@query(
    "zero_volume_move",
    sql(
        "n5m",
        "w AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY bar_no) AS prev_close FROM n5m)",
        "SELECT symbol, ts, close, prev_close FROM w WHERE volume = 0 AND close <> prev_close",
    ),
)
def zero_volume_move(spark, sf):
    return show(Q.zero_volume_moves(numbered(spark, sf, "5min")), cols=["symbol", "close", "prev_close"])


@query(
    "split_suspect",
    sql(
        "n1d",
        "w AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_no) - 1 AS move FROM n1d), "
        "ev AS (SELECT symbol, ts FROM b1d WHERE day(ts) % 5 = 0)",
        f"SELECT symbol, ts, {rd('move')} AS move FROM w WHERE abs(move) > 0.4 "
        "AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.symbol = w.symbol AND ev.ts = w.ts)",
    ),
)
def split_suspect(spark, sf):
    # the tables hold no splits; every fifth day of a month stands for one
    known_splits = bars(spark, sf, "1d").where(F.dayofmonth("ts") % 5 == 0).select("symbol", "ts")
    out = Q.split_suspects(numbered(spark, sf, "1d"), known_splits)
    return show(out, r(F.col("move")).alias("move"), cols=["symbol"])


FETCH = (
    f"f AS (SELECT symbol, time_bucket({secs('1h')}, ts) AS ts, seq, price FROM ticks)"
)


@query("dedupe_first", sql("ticks", FETCH, "SELECT symbol, ts, min(seq) AS seq, arg_min(price, seq) AS price FROM f GROUP BY 1, 2"))
def dedupe_first(spark, sf):
    t = ticks(spark, sf).select("symbol", B.floor_ts(F.col("ts"), 3600).alias("ts"), "seq", "price")
    return show(Q.keep_first(t, ["symbol", "ts"], ["seq"]), cols=["symbol", "seq", "price"])


@query("dedupe_last", sql("ticks", FETCH, "SELECT symbol, ts, max(seq) AS seq, arg_max(price, seq) AS price FROM f GROUP BY 1, 2"))
def dedupe_last(spark, sf):
    t = ticks(spark, sf).select("symbol", B.floor_ts(F.col("ts"), 3600).alias("ts"), "seq", "price")
    return show(Q.keep_last(t, ["symbol", "ts"], ["seq"]), cols=["symbol", "seq", "price"])


@query(
    "buy_hold",
    sql("b1h", f"SELECT symbol, {rd('arg_max(close, ts) / arg_min(close, ts) - 1')} AS buy_hold FROM b1h GROUP BY 1"),
)
def buy_hold(spark, sf):
    b = bars(spark, sf, "1h")
    ratio = div(F.max_by("close", "ts"), F.min_by("close", "ts"))
    return b.groupBy("symbol").agg(r(ratio - 1).alias("buy_hold"))


#: how many symbols a sweep takes
TOP_SYMBOLS = 50


@query(
    "top_dollar_volume",
    sql("b15m", f"SELECT symbol, {rd('sum(close * volume)', 2)} AS dollar_volume FROM b15m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {TOP_SYMBOLS}"),
)
def top_dollar_volume(spark, sf):
    b = bars(spark, sf, "15min")
    per = b.groupBy("symbol").agg(F.sum(F.col("close") * F.col("volume")).alias("dv"))
    return per.orderBy(F.desc("dv"), "symbol").limit(TOP_SYMBOLS).select("symbol", r(F.col("dv"), 2).alias("dollar_volume"))


@query(
    "tape_features",
    sql(
        "ticks",
        "t AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY seq) AS prev FROM ticks), "
        f"m AS (SELECT symbol, time_bucket({secs('15min')}, ts) AS ts, sum(size) AS volume, "
        "sum(CASE WHEN price > prev THEN size WHEN price < prev THEN -size ELSE 0 END) AS delta, "
        "sum(CASE WHEN size >= 90 THEN size ELSE 0 END) AS big FROM t GROUP BY 1, 2)",
        f"SELECT symbol, ts, CAST(delta AS BIGINT) AS delta, {rd('big / nullif(volume, 0)')} AS big_share, "
        f"{rd('volume / nullif(avg(volume) OVER (PARTITION BY symbol, CAST(ts AS TIME) ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)')} "
        "AS relative_volume FROM m",
    ),
)
def tape_features_query(spark, sf):
    from tapeloom.operators.tape import tape_features

    out = tape_features(ticks(spark, sf), "15min", big_size=90)
    return show(
        out, "delta", r(F.col("big_share")).alias("big_share"), r(F.col("relative_volume")).alias("relative_volume"),
        cols=["symbol"],
    )


@query(
    "thin_curve",
    sql(
        "b1m",
        f"s AS (SELECT symbol, time_bucket({secs('15min')}, ts) AS slot, ts, close FROM b1m)",
        "SELECT symbol, slot AS ts, arg_max(close, ts) AS close FROM s GROUP BY 1, 2",
    ),
)
def thin_curve(spark, sf):
    return show(B.thinned(bars(spark, sf, "1min"), "close"), cols=["symbol", "close"])
