import pandas as pd
from helpers import mk, rows
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.operators import quality as Q
from tapeloom.operators import signals as S
from tapeloom.operators.gates import is_event_day

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def minute_bars(spark, stamps, price=1.0):
    return mk(spark, 
        [("A", pd.Timestamp(t), price + i, price + i, price + i, price + i, 1.0) for i, t in enumerate(stamps)], SCHEMA
    )


def test_session_bars_start_at_the_open_on_both_sides_of_a_clock_change(spark):
    # New York is UTC-5 on 7 March 2025 and UTC-4 on 10 March
    bars = minute_bars(spark, ["2025-03-07 14:30", "2025-03-07 16:29", "2025-03-10 13:30", "2025-03-10 15:29", "2025-03-10 15:30"])
    got = [str(r.ts) for r in B.resample_session(bars, "2h").orderBy("ts").collect()]
    assert got == ["2025-03-07 14:30:00", "2025-03-10 13:30:00", "2025-03-10 15:30:00"]
    daily = [str(r.ts) for r in B.resample_session(bars, "1d").orderBy("ts").collect()]
    assert daily == ["2025-03-07 14:30:00", "2025-03-10 13:30:00"]


def test_half_day_and_holiday(spark):
    day = pd.Timestamp("2025-07-03")
    cal = mk(spark, 
        [(day.date(), pd.Timestamp("2025-07-03 13:30"), pd.Timestamp("2025-07-03 17:00"))],
        "day date, open_utc timestamp, close_utc timestamp",
    )
    bars = minute_bars(spark, ["2025-07-03 13:29", "2025-07-03 13:30", "2025-07-03 16:59", "2025-07-03 17:00", "2025-07-04 15:00"])
    got = [r.session for r in B.tag_session(bars, cal).orderBy("ts").collect()]
    assert got == ["premarket", "regular", "regular", "postmarket", "closed"]


def test_late_and_end_of_day_masks(spark):
    bars = minute_bars(spark, ["2025-01-06 20:44", "2025-01-06 20:45", "2025-01-07 15:00"])
    got = [(r.late, r.eod) for r in B.session_masks(bars).orderBy("ts").collect()]
    assert got == [(False, False), (True, True), (False, True)]


def test_keep_first_and_last(spark):
    df = mk(spark, [("k", 2, "b"), ("k", 1, "a"), ("k", 3, "c")], "k string, o int, v string")
    assert Q.keep_first(df, ["k"], ["o"]).first().v == "a"
    assert Q.keep_last(df, ["k"], ["o"]).first().v == "c"


def test_ohlc_predicate(spark):
    bad = [(2, 3, 1, 2, 1), (2, 3, 2.5, 2, 1), (2, 1.5, 1, 2, 1), (2, 3, 0, 2, 1), (2, 3, 1, 2, -1)]
    df = mk(spark, 
        [("A", pd.Timestamp("2025-01-01"), *map(float, r)) for r in bad], SCHEMA
    )
    assert Q.ohlc_violations(df).first().ohlc_violations == 4


def test_event_days(spark):
    days = ["2025-01-29", "2025-01-03", "2025-01-10", "2025-01-30"]
    df = mk(spark, [(pd.Timestamp(d).date(),) for d in days], "d date")
    assert [r[0] for r in df.select(is_event_day(F.col("d"))).collect()] == [True, True, False, False]


def numbered(spark, ohlc, start="2025-01-06 14:30", freq="1h"):
    ts = pd.date_range(start, periods=len(ohlc), freq=freq)
    return mk(spark, 
        [("A", t.to_pydatetime(), i, *map(float, r), 1.0) for i, (t, r) in enumerate(zip(ts, ohlc))],
        "symbol string, ts timestamp, bar_no long, open double, high double, low double, close double, volume double",
    )


def closes(values):
    return [(v, v + 0.5, v - 0.5, v) for v in values]


def test_strict_wants_one_outside_close(spark):
    flat = [10.0, 10.2] * 5
    one = numbered(spark, closes([*flat, 5.0, 10.0]))
    two = numbered(spark, closes([*flat, 5.0, 4.0, 10.0]))

    def dirs(bars, strict):
        return [r.dir for r in S.fffd(bars, dev=1.5, strict=strict, window=6).where("dir = 1").collect()]

    assert dirs(one, True) == [1] and dirs(one, False) == [1]
    assert dirs(two, False) == [1] and dirs(two, True) == []
    hit = S.fffd(one, dev=1.5, window=6).where("dir = 1").first()
    assert (hit.trigger, hit.stop) == (10.5, 4.5)


def test_opening_range_break_of_both_sides_is_long_and_single(spark):
    ohlc = [(10, 11, 9, 10), (10, 12, 8, 10), (10, 13, 7, 10), (10, 20, 1, 10)]
    got = S.orb(None, numbered(spark, ohlc, freq="30min"), "30min", range_min=60)
    assert rows(got, "entry_no", "dir", "price") == [(2, 1, 12.0)]


def test_families_dispatch(spark):
    from helpers import random_bars, to_spark

    pdf = random_bars(400, symbols=("A",), freq="15min")
    bars = to_spark(spark, pdf)
    hourly = B.number_bars(B.resample(bars, "1h"))
    for kind, params in {
        "ma_cross": {"fast": 3, "slow": 9},
        "donchian": {"window": 10},
        "boll": {"dev": 1.0},
        "macd": {},
        "mom": {"window": 3, "thr": 0.005},
        "rsi_cross": {"lo": 45, "hi": 55},
        "orb": {"range_min": 60},
        "vwap": {"mode": "cross", "warmup_bars": 3},
        "fffd_ff": {"dev": 1.0},
        "wick_bb": {"dev": 0.5, "wick_k": 0.1, "trend": 20},
        "didi": {"tol_bars": 2},
        "fffd": {"dev": 1.0},
    }.items():
        out = S.generate(kind, hourly, bars, "1h", params)
        assert out.columns == S.ENTRY
        late = out.join(bars.select("symbol", F.col("bar_no").alias("entry_no"), "ts"), ["symbol", "entry_no"])
        assert late.where("ts <> entry_ts").count() == 0
