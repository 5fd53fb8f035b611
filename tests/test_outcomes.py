import numpy as np
import pandas as pd
import pytest
from helpers import mk, random_bars, rows, to_spark
from pyspark.sql import functions as F

from tapeloom.operators import outcomes as O
from tapeloom.session import stage
from tapeloom.operators import signals as S
from tapeloom.operators.bars import number_bars, resample


def brute_breakouts(events, bars, setup, validity=2):
    """Watch the tape bar by bar with one armed order per side."""
    width = pd.Timedelta(setup)
    fires = []
    for sym, b in bars.groupby("symbol"):
        b = b.sort_values("ts")
        for side in (1, -1):
            queue = events[(events.symbol == sym) & (events.dir == side)].sort_values("ts").to_dict("records")
            order = None
            for bar in b.itertuples():
                while queue and queue[0]["ts"] + width <= bar.ts:
                    order = queue.pop(0)
                if order is None or bar.ts >= order["ts"] + (validity + 1) * width:
                    continue
                if side * ((bar.high if side > 0 else bar.low) - order["trigger"]) > 0:
                    price = max(bar.open, order["trigger"]) if side > 0 else min(bar.open, order["trigger"])
                    fires.append((sym, side, order["ts"].to_pydatetime(), bar.bar_no, price))
                    order = None
    return sorted(fires)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_breakouts_equal_a_bar_by_bar_watch(spark, seed):
    pdf = random_bars(1500, symbols=("A", "B"), seed=seed, freq="15min")
    bars = to_spark(spark, pdf)
    hourly = number_bars(resample(bars, "1h"))
    events = S.fffd(hourly, dev=1.0)
    got = rows(O.breakout_entries(events, bars, "1h"), "symbol", "dir", "signal_ts", "entry_no", "price")
    assert len(got) > 20
    assert got == brute_breakouts(events.toPandas(), pdf, "1h")


def test_newer_signal_takes_the_slot(spark):
    bars = mk(spark, 
        [("A", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=15 * i), i, 10.0, float(h), 9.0, 10.0, 1.0)
         for i, h in enumerate([10, 10, 10, 10, 10, 10, 10, 10, 12, 12, 15, 15])],
        "symbol string, ts timestamp, bar_no long, open double, high double, low double, close double, volume double",
    )
    t0 = pd.Timestamp("2024-01-01")
    events = mk(spark, 
        [("A", t0, 0, 1, 11.0, None), ("A", t0 + pd.Timedelta(hours=1), 1, 1, 14.0, None)],
        "symbol string, ts timestamp, bar_no long, dir int, trigger double, stop double",
    )
    # the first order would fire on bar 8, but from that bar on the second one is armed
    assert rows(O.breakout_entries(events, bars, "1h"), "entry_no", "price") == [(10, 14.0)]


BAR = "symbol string, ts timestamp, bar_no long, open double, high double, low double, close double, volume double"


def path(spark, ohlc):
    t0 = pd.Timestamp("2024-01-01")
    return mk(spark, 
        [("A", t0 + pd.Timedelta(hours=i), i, *map(float, r), 1.0) for i, r in enumerate(ohlc)], BAR
    )


def entry(spark, side=1, price=100.0):
    return mk(spark, [("A", 0, side, price)], "symbol string, entry_no long, dir int, price double")


@pytest.mark.parametrize(
    "side, ohlc, want",
    [
        (1, [(100, 115, 85, 100)], (1, 90.0, "stop")),  # both touched: the stop wins
        (1, [(80, 85, 75, 80)], (1, 80.0, "stop")),  # gap through the stop fills at the open
        (1, [(120, 125, 118, 120)], (1, 120.0, "target")),
        (1, [(100, 105, 95, 101), (100, 111, 95, 100)], (2, 110.0, "target")),
        (1, [(100, 105, 95, 101), (100, 105, 95, 102), (100, 105, 95, 103)], (3, 103.0, "time")),
        (-1, [(100, 112, 95, 100)], (1, 110.0, "stop")),
        (-1, [(100, 105, 89, 100)], (1, 90.0, "target")),
        (1, [(100, 101, 99, 100)], (None, None, None)),  # still open
    ],
)
def test_first_touch(spark, side, ohlc, want):
    bars = path(spark, [(100, 100, 100, 100), *ohlc])
    out = O.barrier_outcomes(O.with_barriers(entry(spark, side), 0.1, 0.1), bars, 3).first()
    assert (out.exit_no, out.exit_price and round(out.exit_price, 9), out.exit_reason) == want


def test_entry_bar_can_stop_a_fill_inside_it(spark):
    bars = path(spark, [(80, 115, 85, 100), (100, 101, 99, 100)])
    plain = O.with_barriers(entry(spark), 0.1, 0.5)
    assert O.barrier_outcomes(plain, bars, 1).first().exit_reason == "time"
    out = O.barrier_outcomes(plain, bars, 1, first_bar=0).first()
    assert (out.exit_no, out.exit_price, out.exit_reason) == (0, 90.0, "stop")


def test_flat_at_session_end_and_opposite_signal(spark):
    bars = path(spark, [(100, 100, 100, 100), (101, 102, 99, 101), (103, 104, 99, 102)])
    plain = O.with_barriers(entry(spark))
    eod = mk(spark, [("A", 1, True)], "symbol string, bar_no long, eod boolean")
    assert O.barrier_outcomes(plain, bars, 5, flags=eod).first().exit_price == 101.0
    turn = mk(spark, [("A", 2, -1)], "symbol string, bar_no long, opposite int")
    out = O.barrier_outcomes(plain, bars, 5, flags=turn).first()
    assert (out.exit_price, out.exit_reason) == (103.0, "opposite")


def test_trailing_stop_uses_earlier_peaks_only(spark):
    bars = path(spark, [(100, 100, 100, 100), (100, 130, 95, 120), (118, 119, 116, 118)])
    out = O.trailing_outcomes(entry(spark), bars, 0.1, 10).first()
    # on bar 1 the peak is still the entry (stop 90); bar 2 opens above the new stop 117 and trades through it
    assert (out.exit_no, round(out.exit_price, 9), out.exit_reason) == (2, 117.0, "trail")


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_single_position_selection(spark, chunk):
    rng = np.random.default_rng(chunk)
    recs = []
    for key, n in (("hot", 300), ("a", 40), ("b", 1)):
        t = pd.Timestamp("2024-01-01")
        for i in range(n):
            t += pd.Timedelta(hours=int(rng.integers(0, 5)))
            recs.append((key, t, t + pd.Timedelta(hours=int(rng.integers(0, 40))), i))
    df = mk(spark, recs, "symbol string, entry_ts timestamp, exit_ts timestamp, id int")
    want = []
    for key, g in pd.DataFrame(recs, columns=["k", "s", "e", "i"]).groupby("k"):
        free = pd.Timestamp.min
        for r in g.sort_values(["s", "i"]).itertuples():
            if r.s >= free:
                want.append((key, r.i))
                free = r.e
    got = rows(O.non_overlapping(df, ["symbol"], tie=["id"], chunk=chunk), "symbol", "id")
    assert got == sorted(want)


@pytest.mark.parametrize("whole", [0, 50, 1000])
def test_keys_walked_whole_and_in_chunks_agree(spark, whole):
    """No end, no key, ends before the entry and equal entries; keys shorter and longer than a task takes. One unknown entry silences its key."""
    rng = np.random.default_rng(5)
    t0, recs = pd.Timestamp("2024-01-01"), []
    for key, label, n in (("a", "x", 120), ("a", "y", 30), ("b", "x", 60), (None, "x", 5)):
        for i in range(n):
            s = t0 + pd.Timedelta(hours=int(rng.integers(0, 2 * n)))
            recs.append((key, label, s, s + pd.Timedelta(hours=int(rng.integers(-2, 9))), i))
    recs += [("b", "x", t0 + pd.Timedelta(hours=100), None, 99), ("c", "x", None, t0, 0), ("c", "x", t0, t0, 1)]
    schema = "symbol string, label string, entry_ts timestamp, exit_ts timestamp, id int"
    want, free = [], {}
    for key, label, s, e, i in sorted((r for r in recs if r[0] not in (None, "c")), key=lambda r: (r[0], r[1], r[2], r[4])):
        if s >= free.get((key, label), s):
            free[key, label] = pd.Timestamp.max if e is None else e
            want.append((key, label, i))
    got = O.non_overlapping(mk(spark, recs, schema), ["symbol", "label"], tie=["id"], chunk=8, whole=whole)
    assert got.columns == ["symbol", "label", "entry_ts", "exit_ts", "id"]
    assert rows(got, "symbol", "label", "id") == sorted(want)


def test_short_keys_need_no_chunks(spark, monkeypatch):
    labels = []

    def staged(df, label):
        labels.append(label)
        return stage(df, label)

    monkeypatch.setattr(O, "stage", staged)
    t0 = pd.Timestamp("2024-01-01")
    recs = [(k, t0 + pd.Timedelta(hours=i), t0 + pd.Timedelta(hours=i + 3), i) for k in "ab" for i in range(30)]
    df = mk(spark, recs, "symbol string, entry_ts timestamp, exit_ts timestamp, id int")
    got = O.non_overlapping(df, ["symbol"], tie=["id"])
    assert rows(got, "symbol", "id") == [(k, i) for k in "ab" for i in range(0, 30, 3)]
    assert labels == ["long-keys"]


def test_costs(spark):
    one = spark.range(1).select(
        O.closed_pnl(F.lit("short"), F.lit(10.0), F.lit(100.0), F.lit(90.0), F.lit(0.001)).alias("pnl"),
        O.restate_fee_pct(F.lit(0.002), F.lit(0.001)).alias("fee"),
        O.minimum_fee_shortfall_pct(0.35, F.lit(100.0), F.lit(0.035)).alias("short"),
    ).first()
    assert round(one.pnl, 6) == 98.1
    assert round(one.fee, 9) == 0.2
    assert round(one.short, 9) == 0.63


@pytest.mark.parametrize("hours", [1, 30])
def test_one_position_on_a_hot_key(spark, hours):
    """Trades a minute apart that stay open far longer than a chunk has trades: the jumps double over the chunks."""
    t0, minute = pd.Timestamp("2024-01-01"), pd.Timedelta(minutes=1)
    recs = [("hot", t0 + i * minute, t0 + (i + 60 * hours + i % 7) * minute, i) for i in range(6000)]
    df = mk(spark, recs, "symbol string, entry_ts timestamp, exit_ts timestamp, id long")
    free, want = t0, []
    for _, entry, end, i in recs:
        if entry >= free:
            free = end
            want.append(i)
    got = O.non_overlapping(df, ["symbol"], tie=["id"], chunk=64)
    assert sorted(r.id for r in got.select("id").collect()) == want
