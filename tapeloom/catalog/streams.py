"""Streaming queries: the tape is replayed through Structured Streaming and closed results are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import full, ny, query, rd, secs, sql
from tapeloom.catalog.metrics import LONG, OPEN, lasting
from tapeloom.catalog.outcomes import ENT, next_bar_entries
from tapeloom.catalog.signals import band_flags, fffd_sql
from tapeloom.functions.columns import add_tf, ntz, r
from tapeloom.operators import indicators as I
from tapeloom.operators import portfolio as P
from tapeloom.operators import signals as S
from tapeloom.session import scratch_path
from tapeloom.sources.tables import numbered, ticks
from tapeloom.streaming import jobs as J
from tapeloom.streaming import joins as SJ


def replay(df, label):
    """Write rows as a file source and open them as a stream."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(stream, label):
    return J.run_available(stream, scratch_path(stream.sparkSession, label))


def doubled(spark, sf):
    """The tape delivered twice, as an overlapping refetch does."""
    t = ticks(spark, sf)
    return t.unionByName(t)


CLOSED = "(SELECT max(ts) FROM ticks) - INTERVAL 16 MINUTE"


@query("stream_dedupe", sql("ticks", "SELECT symbol, ts, seq, price, size FROM ticks"))
def stream_dedupe(spark, sf):
    out = run(J.deduped(replay(doubled(spark, sf), "tape")), "dedupe")
    return out.select("symbol", ntz(F.col("ts")).alias("ts"), "seq", "price", "size")


@query(
    "stream_bars",
    sql("b15m", f"SELECT symbol, ts, open, high, low, close, volume FROM b15m WHERE ts + {secs('15min')} <= {CLOSED}"),
)
def stream_bars(spark, sf):
    out = run(J.tumbling_bars(J.deduped(replay(doubled(spark, sf), "tape")), "15 minutes"), "bars")
    return out.withColumn("ts", ntz(F.col("ts")))


@query(
    "stream_session",
    sql(
        "ticks",
        "g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)), "
        "s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts) AS sid FROM g)",
        "SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n, CAST(sum(size) AS BIGINT) AS volume FROM s GROUP BY symbol, sid "
        f"HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}",
    ),
)
def stream_session(spark, sf):
    tape = replay(ticks(spark, sf), "tape").withWatermark("ts", J.WATERMARK)
    out = run(J.session_activity(tape, "30 minutes"), "session")
    return out.withColumn("start", ntz(F.col("start"))).withColumn("end", ntz(F.col("end")))


ARMED = (
    band_flags("stddev_pop", 1.5) + ", z AS (" + fffd_sql() + "), "
    "sg AS (SELECT symbol, ts + INTERVAL 1 HOUR AS seen, ts + INTERVAL 4 HOUR AS expiry, dir, trigger FROM z), "
    f"mn AS (SELECT symbol, time_bucket({secs('1min')}, ts) AS ts, arg_max(price, seq) AS price FROM ticks GROUP BY 1, 2), "
    "lk AS (SELECT mn.*, seen, expiry, dir, trigger FROM mn ASOF JOIN sg ON mn.symbol = sg.symbol AND mn.ts >= sg.seen), "
    f"fi AS (SELECT * FROM lk WHERE ts <= expiry AND CASE WHEN dir = 1 THEN price > trigger ELSE price < trigger END AND ts + INTERVAL 1 MINUTE <= {CLOSED})"
)


@query(
    "stream_armed",
    sql("ticks n1h", ARMED,
        "SELECT symbol, seen AS signal_ts, min(ts) AS fire_ts, any_value(dir) AS dir, any_value(trigger) AS trigger, arg_min(price, ts) AS price FROM fi GROUP BY 1, 2"),
)
def stream_armed(spark, sf):
    """Band re-entry signals, visible at their bar's close and armed for two more bars."""
    return fires(spark, sf, True)


WEEKDAY = f"date_part('isodow', ts) < 6 AND date_part('hour', {ny('ts')}) * 60 + date_part('minute', {ny('ts')}) BETWEEN 570 AND 929"


@query(
    "stream_armed_hours",
    sql("ticks n1h", ARMED,
        f"SELECT symbol, seen AS signal_ts, min(ts) AS fire_ts, any_value(dir) AS dir, any_value(trigger) AS trigger, arg_min(price, ts) AS price FROM fi WHERE {WEEKDAY} GROUP BY 1, 2"),
)
def stream_armed_hours(spark, sf):
    """The same within the entry window, 09:30 to 15:30 in New York on weekdays."""
    return fires(spark, sf, False)


def fires(spark, sf, all_hours):
    signals = S.fffd(numbered(spark, sf, "1h"), 1.5).select("symbol", add_tf(F.col("ts"), "1h").alias("ts"), "dir", "trigger")
    out = SJ.first_fires(replay(ticks(spark, sf), "tape"), replay(signals, "signals"), "3 hours", scratch_path(spark, "armed"), all_hours)
    return out.select(
        "symbol", ntz(F.col("signal_ts")).alias("signal_ts"), ntz(F.col("fire_ts")).alias("fire_ts"),
        F.col("dir").cast("long").alias("dir"), "trigger", "price",
    )


POSITIONS = (
    "op AS (SELECT symbol, entry_ts + INTERVAL 1 HOUR AS seen, entry_no * 2 + CASE WHEN dir = 1 THEN 1 ELSE 0 END AS position_id, dir, price * (1 - dir * 0.6) AS sl, price * (1 + dir * 0.9) AS tp FROM ent), "
    f"mn AS (SELECT symbol, time_bucket({secs('1min')}, ts) AS ts, arg_max(price, seq) AS px, "
    "date_part('hour', ((time_bucket(INTERVAL '60 seconds', ts) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')) * 60 + "
    "date_part('minute', ((time_bucket(INTERVAL '60 seconds', ts) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')) >= 955 AS flat FROM ticks GROUP BY ALL), "
    f"bd AS MATERIALIZED (SELECT symbol, ts + INTERVAL 4 HOUR AS seen_band, {full('avg(close)', 20)} AS lvl FROM n4h), "
    "mb AS MATERIALIZED (SELECT mn.*, lvl FROM mn ASOF LEFT JOIN bd ON mn.symbol = bd.symbol AND mn.ts >= bd.seen_band), "
    "hp AS (SELECT op.*, mn.ts, lvl, CASE WHEN dir * (px - sl) <= 0 THEN 'stop' WHEN dir * (px - tp) >= 0 THEN 'target' WHEN dir * (px - lvl) >= 0 THEN 'band' WHEN flat THEN 'eod' END AS reason, px FROM op JOIN mb AS mn ON mn.symbol = op.symbol AND mn.ts >= seen "
    f"WHERE mn.ts + INTERVAL 1 MINUTE <= {CLOSED})"
)


@query(
    "stream_positions",
    sql("ticks n1h n4h", ENT, POSITIONS,
        "SELECT symbol, position_id, min(ts) AS exit_ts, arg_min(reason, ts) AS reason, "
        f"{rd('arg_min(CASE reason WHEN ' + chr(39) + 'stop' + chr(39) + ' THEN sl WHEN ' + chr(39) + 'target' + chr(39) + ' THEN tp WHEN ' + chr(39) + 'band' + chr(39) + ' THEN lvl ELSE px END, ts)')} AS exit_price FROM hp WHERE reason IS NOT NULL GROUP BY 1, 2"),
)
def stream_positions(spark, sf):
    e = next_bar_entries(numbered(spark, sf, "1h"))
    opens = e.select(
        "symbol",
        add_tf(F.col("entry_ts"), "1h").alias("ts"),
        (F.col("entry_no") * 2 + F.when(F.col("dir") == 1, 1).otherwise(0)).alias("position_id"),
        "dir",
        (F.col("price") * (1 - F.col("dir") * 0.6)).alias("sl"),
        (F.col("price") * (1 + F.col("dir") * 0.9)).alias("tp"),
    )
    four = I.sma(numbered(spark, sf, "4h"), [20]).where("sma_20 is not null")
    bands = four.select(
        "symbol", add_tf(F.col("ts"), "4h").alias("ts"), F.col("sma_20").alias("band_long"), F.col("sma_20").alias("band_short")
    )
    out = SJ.first_exits(replay(ticks(spark, sf), "tape"), replay(opens, "opens"), replay(bands, "bands"), "10 days", scratch_path(spark, "positions"))
    return out.select(
        "symbol", "position_id", ntz(F.col("exit_ts")).alias("exit_ts"), "reason", r(F.col("exit_price")).alias("exit_price")
    )


@query(
    "risk_guard",
    sql("trades", LONG, OPEN.format(k="cfg"),
        "bk AS (SELECT cfg AS k, xts AS ts, sum(ret * 1000) AS pnl FROM lt GROUP BY 1, 2), "
        "tl AS (SELECT coalesce(r.k, b.k) AS k, coalesce(r.ts, b.ts) AS ts, open_count, e, pnl FROM (SELECT * FROM run WHERE e > 0) r FULL JOIN bk b ON r.k = b.k AND r.ts = b.ts), "
        "dy AS (SELECT *, coalesce(sum(pnl) OVER (PARTITION BY k, CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE) ORDER BY ts), 0) AS day_pnl FROM tl)",
        f"SELECT k AS key, ts, CAST(open_count AS BIGINT) AS open_count, {rd('day_pnl')} AS day_pnl, CASE WHEN open_count > 110 THEN 'max open positions' "
        "WHEN round(day_pnl, 9) <= -50 THEN 'daily loss' END AS blocked FROM dy WHERE e > 0"),
)
def risk_guard(spark, sf):
    t = lasting(spark, sf).withColumnRenamed("cfg", "key")
    opens = P.open_positions(t, ["key"], F.col("qty")).select("key", "ts", "open_count")
    g = J.risk_guard(opens, t.withColumn("pnl", F.col("ret") * 1000), 110, 50.0)
    return g.select("key", ntz(F.col("ts")).alias("ts"), "open_count", r(F.col("day_pnl")).alias("day_pnl"), "blocked")


# ---------------------------------------------------------------- streams with streams, kept tables


@query(
    "stream_interval_join",
    sql("ticks n1h", ARMED,
        "SELECT t.symbol, t.ts, t.seq, t.price, sg.seen AS signal_ts, CAST(sg.dir AS BIGINT) AS dir, sg.trigger FROM ticks t JOIN sg ON sg.symbol = t.symbol AND t.ts >= sg.seen AND t.ts <= sg.seen + INTERVAL 3 HOUR "
        "AND CASE WHEN sg.dir = 1 THEN t.price > sg.trigger ELSE t.price < sg.trigger END"),
)
def stream_interval_join(spark, sf):
    """Every tick beyond the trigger of a signal of the last three hours: two streams with a watermark each."""
    signals = S.fffd(numbered(spark, sf, "1h"), 1.5).select("symbol", add_tf(F.col("ts"), "1h").alias("ts"), "dir", "trigger")
    beyond = F.when(F.col("r_dir") == 1, F.col("price") > F.col("r_trigger")).otherwise(F.col("price") < F.col("r_trigger"))
    tape = replay(ticks(spark, sf), "tape").select("symbol", "ts", "seq", "price")
    out = run(SJ.interval_join(tape, replay(signals, "signals"), ["symbol"], "3 hours", when=beyond), "interval")
    return out.select(
        "symbol", ntz(F.col("ts")).alias("ts"), "seq", "price", ntz(F.col("r_ts")).alias("signal_ts"),
        F.col("r_dir").cast("long").alias("dir"), F.col("r_trigger").alias("trigger"),
    )


@query(
    "stream_sliding",
    sql("ticks", "w AS (SELECT symbol, price, seq, unnest([time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 10 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts)]) AS start FROM ticks)",
        "SELECT symbol, start, start + INTERVAL 15 MINUTE AS \"end\", arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, count(*) AS n FROM w "
        f"GROUP BY symbol, start HAVING start + INTERVAL 15 MINUTE <= {CLOSED}"),
)
def stream_sliding(spark, sf):
    """Bars of 15 minutes beginning every five, as they close."""
    out = run(SJ.sliding_bars(replay(ticks(spark, sf), "tape"), "15 minutes", "5 minutes"), "sliding")
    return out.withColumn("start", ntz(F.col("start"))).withColumn("end", ntz(F.col("end")))


@query("stream_keep_last", sql("ticks", "SELECT symbol, ts, seq, price, size FROM ticks"))
def stream_keep_last(spark, sf):
    """A refetch corrects what came first: of the versions of a tick the last one stays, in one table kept by batches."""
    final = ticks(spark, sf).withColumn("version", F.lit(2))
    early = final.withColumns({"version": F.lit(1), "price": F.col("price") * 2})
    path = scratch_path(spark, "kept")
    stream = replay(final.unionByName(early), "tape")
    once = lambda b: b.groupBy("symbol", "seq").agg(F.max_by(F.struct("ts", "price", "size", "version"), "version").alias("r")).select("symbol", "seq", "r.*")
    SJ.upsert(stream, path, prepare=once)
    kept = SJ.upserted(spark, path, stream.schema, ["symbol", "seq"], newest=["version"])
    return kept.select("symbol", ntz(F.col("ts")).alias("ts"), "seq", "price", "size")


@query(
    "stream_paper_daily",
    sql("trades", LONG, f"wl AS (SELECT {ny('xts')} AS wall, ret FROM lt)",
        f"SELECT CAST(CAST(wall AS DATE) AS VARCHAR) AS day, count(*) AS closed, count(*) FILTER (WHERE ret > 0) AS wins, {rd('sum(ret * 1000)', 4)} AS pnl FROM wl "
        "GROUP BY CAST(wall AS DATE) HAVING CAST(wall AS DATE) + INTERVAL 1 DAY <= (SELECT max(wall) - INTERVAL 1 DAY FROM wl)"),
)
def stream_paper_daily(spark, sf):
    """The daily summary as a stream: a local day is written once, a day after its end; batches can be delivered again."""
    t = lasting(spark, sf).select("exit_ts", (F.col("ret") * 1000).alias("pnl"))
    days, path = SJ.daily_results(replay(t, "ledger")), scratch_path(spark, "daily")
    SJ.upsert(days, path)
    out = SJ.upserted(spark, path, days.schema, ["day"])
    return out.select(F.col("day").cast("string").alias("day"), "closed", "wins", r(F.col("pnl"), 4).alias("pnl"))


@query(
    "stream_guard",
    sql("trades", LONG, f"dy AS (SELECT cfg AS key, CAST({ny('xts')} AS DATE) AS day, count(*) AS closed, sum(ret * 1000) AS pnl FROM lt GROUP BY 1, 2)",
        f"SELECT key, CAST(day AS VARCHAR) AS day, closed, {rd('pnl', 4)} AS pnl, round(pnl, 9) <= -50 AS paused FROM dy"),
)
def stream_guard(spark, sf):
    """Daily loss guard as a stream: running sums per key and local day, the newest row per day kept."""
    t = lasting(spark, sf).select(F.col("cfg").alias("key"), "exit_ts", (F.col("ret") * 1000).alias("pnl"))
    days, path = SJ.guard_days(replay(t, "ledger"), 50.0), scratch_path(spark, "guard")
    SJ.upsert(days, path, mode="update")
    out = SJ.upserted(spark, path, days.schema, ["key", "day"])
    return out.select("key", F.col("day").cast("string").alias("day"), "closed", r(F.col("pnl"), 4).alias("pnl"), "paused")
