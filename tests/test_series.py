import numpy as np
import pandas as pd
import pytest
from helpers import mk, random_bars, to_spark
from pyspark.sql import functions as F

from tapeloom.operators import indicators as I
from tapeloom.operators.asof import activate, align_setup, asof, span_join
from tapeloom.operators.bars import number_bars
from tapeloom.operators.series import DAY, ema, full_avg, lag, number_rows, prefix_scan, rolling, time_bucket


def by_symbol(df, col):
    pdf = df.select("symbol", "bar_no", col).toPandas().sort_values(["symbol", "bar_no"])
    return {s: g[col].to_numpy(dtype=float) for s, g in pdf.groupby("symbol")}


@pytest.mark.parametrize("chunk", [25, 64, 4096])
def test_rolling_does_not_depend_on_chunk(spark, chunk):
    pdf = random_bars(300)
    out = rolling(
        to_spark(spark, pdf), 22, {"m": full_avg("close", 20)}, {"prev": lag("m")},
        {"nxt": lambda w: F.lead("close", 2).over(w)}, ahead=2, chunk=chunk,
    )
    assert out.count() == 600
    for s, g in pdf.groupby("symbol"):
        m = g["close"].rolling(20).mean()
        np.testing.assert_allclose(by_symbol(out, "m")[s], m, rtol=1e-12)
        np.testing.assert_allclose(by_symbol(out, "prev")[s], m.shift(1), rtol=1e-12)
        np.testing.assert_allclose(by_symbol(out, "nxt")[s], g["close"].shift(-2), rtol=1e-12)


@pytest.mark.parametrize("span", [2, 9, 200])
def test_ema_equals_recursion_over_many_chunks(spark, span):
    pdf = random_bars(6000, symbols=("A",), freq="1min")
    got = by_symbol(ema(to_spark(spark, pdf), "close", span, "e"), "e")["A"]
    np.testing.assert_allclose(got, pdf["close"].ewm(span=span, adjust=False).mean(), rtol=1e-11)


def test_rsi_and_macd(spark):
    pdf = random_bars(3000, symbols=("A",))
    bars = to_spark(spark, pdf)
    d = pdf["close"].diff()
    gain = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    loss = (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    np.testing.assert_allclose(by_symbol(I.rsi(bars), "rsi")["A"], 100 - 100 / (1 + gain / loss), rtol=1e-10)
    line = pdf["close"].ewm(span=12, adjust=False).mean() - pdf["close"].ewm(span=26, adjust=False).mean()
    got = I.macd(bars)
    np.testing.assert_allclose(by_symbol(got, "macd_line")["A"], line, atol=1e-10)
    np.testing.assert_allclose(
        by_symbol(got, "macd_signal")["A"], line.ewm(span=9, adjust=False).mean(), atol=1e-10
    )


def test_flat_prices_have_no_rsi(spark):
    pdf = random_bars(30, symbols=("A",))
    pdf[["open", "high", "low", "close"]] = 5.0
    out = I.adx(I.rsi(to_spark(spark, pdf)))
    assert out.where("rsi is not null or adx is not null").count() == 0


def test_warmup_is_null_never_nan(spark):
    out = I.bollinger(to_spark(spark, random_bars(12)), 20)
    assert out.where("mid is not null or lower is not null or isnan(mid)").count() == 0


def test_numbering_and_scan_with_one_hot_key(spark):
    n = 5000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("symbol"),
        F.timestamp_seconds(F.col("id") * 977).alias("ts"),
        F.col("id").cast("double").alias("v"),
    )
    num = number_rows(df, ["symbol"], ["ts"], time_bucket("ts", 3600), "no")
    scan = prefix_scan(
        num, ["symbol"], ["ts"], time_bucket("ts", 7200),
        {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.when(F.col("v") % 5 == 0, F.col("v")))},
        inclusive=False,
    ).toPandas()
    for _, g in scan.groupby("symbol"):
        g = g.sort_values("ts")
        assert list(g["no"]) == list(range(len(g)))
        np.testing.assert_allclose(g["s"].fillna(0), g["v"].cumsum().shift(1).fillna(0))
        np.testing.assert_allclose(g["m"].fillna(-1), g["v"].cummax().shift(1).fillna(-1))
        last = g["v"].where(g["v"] % 5 == 0).ffill().shift(1)
        np.testing.assert_allclose(g["l"].fillna(-1), last.fillna(-1))


def probe_frame(spark, stamps):
    return mk(spark, [("A", pd.Timestamp(t)) for t in stamps], "symbol string, ts timestamp")


def test_asof_ties(spark):
    values = mk(spark, 
        [("A", pd.Timestamp("2024-01-01 10:00"), 1), ("A", pd.Timestamp("2024-01-03 10:00"), 2)],
        "symbol string, ts timestamp, v int",
    )
    probe = probe_frame(spark, ["2024-01-01 09:59", "2024-01-01 10:00", "2024-01-01 10:00:00.000001", "2024-01-05"])

    def got(**kw):
        return [r.v for r in asof(probe, values, **kw).orderBy("ts").collect()]

    assert got() == [None, 1, 1, 2]
    assert got(allow_equal=False) == [None, None, 1, 2]
    assert got(direction="forward") == [1, 1, 2, None]
    assert got(width=1) == [None, 1, 1, 2]


def test_setup_value_is_invisible_before_its_close(spark):
    setup = mk(spark, [("A", pd.Timestamp("2024-01-01 10:00"), 7.0)], "symbol string, ts timestamp, v double")
    probe = probe_frame(spark, ["2024-01-01 10:59:59.999999", "2024-01-01 11:00"])
    got = [r.v for r in align_setup(probe, setup, "1h", {"v": "v"}).orderBy("ts").collect()]
    assert got == [None, 7.0]
    act = activate(setup, probe.withColumn("n", F.lit(1)), "1h", {"ts": "act_ts"})
    assert [str(r.act_ts) for r in act.collect()] == ["2024-01-01 11:00:00"]


def test_prefix_invariance(spark):
    """What was known at a time does not change when later rows arrive."""
    pdf = random_bars(400, symbols=("A",), freq="15min")
    cut = 250

    def run(p):
        bars = to_spark(spark, p)
        hours = number_bars(
            bars.groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by("close", "ts").alias("close"))
        )
        out = align_setup(bars, I.rsi(hours, 5), "1h", {"rsi": "rsi"})
        return by_symbol(out, "rsi")["A"]

    np.testing.assert_allclose(run(pdf)[:cut], run(pdf[:cut]), rtol=1e-12)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_span_join(spark, how):
    left = mk(spark, [("A", 1, 3, 9), ("A", 2, 7, 7), ("B", 3, 0, 4)], "symbol string, k int, lo int, hi int")
    right = mk(spark, [("A", i) for i in range(20)], "symbol string, n int")
    got = span_join(left, right, ["symbol"], F.col("lo"), F.col("hi"), "n", 4, how)
    hits = sorted((r.k, r.n) for r in got.where("n is not null").collect())
    assert hits == [(1, i) for i in range(3, 10)] + [(2, 7)]
    missing = {r.k for r in got.groupBy("k").agg(F.max("n").alias("m")).where("m is null").collect()}
    assert missing == ({3} if how == "left" else set())
