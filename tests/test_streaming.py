import pandas as pd
from helpers import mk, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import scratch_path
from tapeloom.streaming import jobs as J
from tapeloom.streaming import joins as SJ

TICK = "symbol string, ts timestamp, seq long, price double, size long"


def tick(minute, seq, price, symbol="A"):
    return (symbol, pd.Timestamp("2024-01-02 15:00") + pd.Timedelta(minutes=minute), seq, float(price), 1)


def batches(spark, transform, *parts):
    """Deliver each part in its own run of one query over the same checkpoint."""
    src, out = scratch_path(spark, "src"), scratch_path(spark, "out")
    done = None
    for part in parts:
        mk(spark, part, TICK).coalesce(1).write.mode("append").parquet(src)
        done = J.run_available(transform(spark.readStream.schema(TICK).parquet(src)), out)
    return done


def test_late_rows_and_repeats(spark):
    got = batches(
        spark,
        lambda s: J.tumbling_bars(J.deduped(s), "5 minutes"),
        [tick(0, 1, 10), tick(30, 2, 11)],
        # 14:59 is 31 minutes behind and dropped; 15:20 is 10 behind and kept; seq 2 is a repeat
        [tick(-1, 3, 99), tick(20, 4, 12), tick(30, 2, 11)],
        [tick(90, 5, 13)],
    )
    have = {str(r.ts): (r.close, r.volume) for r in got.collect()}
    assert have["2024-01-02 15:00:00"] == (10.0, 1.0)
    assert have["2024-01-02 15:20:00"] == (12.0, 1.0)
    assert have["2024-01-02 15:30:00"] == (11.0, 1.0)
    assert "2024-01-02 14:55:00" not in have


def streams(spark, *tables):
    out = []
    for df in tables:
        p = scratch_path(spark, "feed")
        df.write.parquet(p)
        out.append(spark.readStream.schema(df.schema).parquet(p))
    return out


def test_signal_fires_once_and_the_newer_one_replaces_it(spark):
    t0 = pd.Timestamp("2024-01-02 15:00")
    minute = pd.Timedelta(minutes=1)
    signals = mk(spark, 
        [("A", t0, 1, 11.0), ("A", t0 + 5 * minute, 1, 20.0), ("B", t0, -1, 5.0)],
        "symbol string, ts timestamp, dir int, trigger double",
    )
    ticks = mk(spark, 
        [tick(1, 1, 11), tick(2, 2, 12), tick(3, 3, 13), tick(6, 4, 15), tick(9, 5, 25), tick(4, 6, 1, "B"), tick(120, 9, 1), tick(120, 10, 9, "B")],
        TICK,
    )
    fired = SJ.first_fires(*streams(spark, ticks, signals), "3 minutes", scratch_path(spark, "fires"))
    # equal is no cross; the second signal expires before 25 prints; B's signal expired before minute 4
    assert rows(fired.select("symbol", "price"), "symbol", "price") == [("A", 12.0)]


def test_positions_close_in_order_of_stop_target_session_end(spark):
    t0 = pd.Timestamp("2024-01-02 15:00")
    opens = mk(spark, 
        [("A", t0, 1, 1, 90.0, 110.0), ("A", t0, 2, -1, 120.0, 80.0), ("A", t0, 3, 1, 50.0, 500.0)],
        "symbol string, ts timestamp, position_id long, dir int, sl double, tp double",
    )
    ticks = mk(spark, [tick(1, 1, 100), tick(2, 2, 115), tick(3, 3, 79), tick(360, 4, 95), tick(500, 5, 95)], TICK)
    closed = SJ.first_exits(*streams(spark, ticks, opens), None, "5 days", scratch_path(spark, "closes"))
    assert rows(closed, "position_id", "exit_price", "reason") == [(1, 110.0, "target"), (2, 80.0, "target"), (3, 95.0, "eod")]


def test_band_level_counts_from_its_bar_close(spark):
    t0 = pd.Timestamp("2024-01-02 15:00")
    opens = mk(spark, [("A", t0, 1, 1, 50.0, 500.0)], "symbol string, ts timestamp, position_id long, dir int, sl double, tp double")
    bands = mk(spark, [("A", t0 + pd.Timedelta(minutes=5), 101.0, 99.0)], "symbol string, ts timestamp, band_long double, band_short double")
    ticks = mk(spark, [tick(2, 1, 105), tick(6, 2, 100), tick(8, 3, 104), tick(200, 4, 104)], TICK)
    closed = SJ.first_exits(*streams(spark, ticks, opens, bands), "5 days", scratch_path(spark, "closes"), None)
    got = closed.first()
    assert (str(got.exit_ts), got.exit_price, got.reason) == ("2024-01-02 15:08:00", 101.0, "band")


def test_risk_guard(spark):
    t0 = pd.Timestamp("2024-01-02 15:00")
    h = pd.Timedelta(hours=1)
    opens = mk(spark, 
        [("k", t0, 1), ("k", t0 + h, 9), ("k", t0 + 3 * h, 2), ("k", t0 + 30 * h, 2)], "key string, ts timestamp, open_count long"
    )
    ledger = mk(spark, [("k", t0 + 2 * h, -60.0)], "key string, exit_ts timestamp, pnl double")
    got = [r.blocked for r in J.risk_guard(opens, ledger, 5, 50.0).orderBy("ts").collect()]
    assert got == [None, "max open positions", "daily loss", None]


# ------------------------------------------------------------------ streams with streams, kept tables


def test_interval_join_over_batches(spark):
    """A signal meets ticks of later batches within its life, and none after it."""
    t0 = pd.Timestamp("2024-01-02 15:00")
    schema = "symbol string, ts timestamp, mark int"
    left, right, out = (scratch_path(spark, n) for n in ("left", "right", "out"))
    mk(spark, [("A", t0, 1), ("B", t0, 2)], schema).coalesce(1).write.parquet(right)
    got = None
    for part in ([tick(1, 1, 5)], [tick(9, 2, 6), tick(9, 3, 7, "B")], [tick(11, 4, 8), tick(-1, 5, 9)]):
        mk(spark, part, TICK).coalesce(1).write.mode("append").parquet(left)
        joined = SJ.interval_join(
            spark.readStream.schema(TICK).parquet(left), spark.readStream.schema(schema).parquet(right), ["symbol"], "10 minutes"
        )
        got = J.run_available(joined, out)
    assert rows(got, "seq", "r_mark") == [(1, 1), (2, 1), (3, 2)]


def test_a_batch_delivered_again_changes_nothing(spark):
    schema = "key string, n int, version int"
    path = scratch_path(spark, "kept")
    write = SJ.batch_writer(path)
    first = spark.createDataFrame([("a", 1, 1), ("b", 5, 1)], schema)
    second = spark.createDataFrame([("a", 2, 1), ("a", 3, 2)], schema)
    kept = lambda: rows(SJ.upserted(spark, path, T._parse_datatype_string(schema), ["key"], newest=["version"]), "key", "n")
    write(first, 0)
    write(second, 1)
    want = [("a", 3), ("b", 5)]
    assert kept() == want
    write(first, 0)
    write(second, 1)
    assert kept() == want


def test_a_day_closes_once(spark):
    """Days come when the watermark has passed them; the total equals the batch sums."""
    schema = "exit_ts timestamp, pnl double"
    src, path = scratch_path(spark, "src"), scratch_path(spark, "daily")
    t0 = pd.Timestamp("2024-01-02 15:00")
    for days in ([0, 0, 1], [1, 2, 4], [5, 9]):
        mk(spark, [(t0 + pd.Timedelta(days=d), 1.0 if d % 2 else -2.0) for d in days], schema).coalesce(1).write.mode("append").parquet(src)
        stream = SJ.daily_results(spark.readStream.schema(schema).parquet(src))
        SJ.upsert(stream, path)
    log = SJ.log_of(spark, path, stream.schema)
    assert log.count() == log.select("day").distinct().count()
    assert [(str(d), n, w, p) for d, n, w, p in rows(log, "day", "closed", "wins", "pnl")] == [
        ("2024-01-02", 2, 0, -4.0), ("2024-01-03", 2, 2, 2.0), ("2024-01-04", 1, 0, -2.0), ("2024-01-06", 1, 0, -2.0), ("2024-01-07", 1, 1, 1.0)
    ]


def test_newest_value_of_a_minute(spark):
    minutes = mk(spark, [("A", pd.Timestamp("2024-01-02 15:00") + pd.Timedelta(minutes=m), float(m)) for m in (0, 2, 6, 30, 300)], "symbol string, ts timestamp, price double")
    values = mk(spark, [("A", pd.Timestamp("2024-01-02 15:01"), 7), ("A", pd.Timestamp("2024-01-02 15:05"), 8), ("A", pd.Timestamp("2024-01-02 20:30"), 9)], "symbol string, ts timestamp, level int")
    paths = [scratch_path(spark, n) for n in ("minutes", "values", "live")]
    minutes.write.parquet(paths[0])
    values.write.parquet(paths[1])
    table, stream = spark.read.parquet(paths[0]), spark.readStream.schema(values.schema).parquet(paths[1])
    got = SJ.newest_value(table, stream, "20 minutes", paths[2])
    assert rows(got.select("price", F.col("value.level").alias("level")), "price", "level") == [(0.0, None), (2.0, 7), (6.0, 8), (30.0, None), (300.0, None)]
