import numpy as np
import pandas as pd
import pytest
from helpers import mk, rows
from pyspark.sql import functions as F

from tapeloom import session
from tapeloom.operators import metrics as M
from tapeloom.operators import portfolio as P
from tapeloom.operators import registry as R
from tapeloom.plans import grid as GR
from tapeloom.plans import robustness as RB
from tapeloom.plans import validate as V
from tapeloom.sources import lake


def test_profit_factor_policies(spark):
    df = mk(spark, 
        [("win", 1.0), ("win", 2.0), ("loss", -1.0), ("mix", 3.0), ("mix", -2.0), ("flat", 0.0)], "k string, r double"
    )
    got = {
        r.k: (r.a, r.b, r.c)
        for r in df.groupBy("k").agg(
            M.profit_factor(F.col("r")).alias("a"),
            M.profit_factor(F.col("r"), "inf_or_zero").alias("b"),
            M.profit_factor(F.col("r"), "inf_or_null").alias("c"),
        ).collect()
    }
    assert got == {
        "win": (None, M.INF, M.INF), "loss": (0.0, 0.0, 0.0), "mix": (1.5, 1.5, 1.5), "flat": (None, 0.0, None)
    }


@pytest.mark.parametrize("bucket", [1, 7, 5000])
def test_drawdown_equals_a_walk(spark, bucket):
    rng = np.random.default_rng(5)
    recs, want = [], {}
    for k in ("a", "b", "up"):
        x = np.abs(rng.normal(size=60)) if k == "up" else rng.normal(size=60)
        cum = peak = worst = 0.0
        for i, v in enumerate(x):
            recs.append((k, pd.Timestamp("2024-01-01") + pd.Timedelta(days=i), float(v)))
            cum += v
            peak = max(peak, cum)
            worst = min(worst, cum - peak)
        want[k] = worst
    df = mk(spark, recs, "k string, day timestamp, pnl double")
    got = {r.k: r.max_drawdown for r in M.max_drawdown(df, ["k"], bucket_days=bucket).collect()}
    assert got == pytest.approx(want)


def test_quantiles_of_a_hot_group_with_heavy_ties(spark):
    rng = np.random.default_rng(2)
    hot = np.r_[np.zeros(500), rng.normal(size=301)]
    cold = rng.normal(size=6)
    df = mk(spark, 
        [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("cold", None)], "k string, v double"
    )
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.k: [r[n] for n in qs] for r in M.quantiles(df, ["k"], "v", qs).collect()}
    np.testing.assert_allclose(got["hot"], np.quantile(hot, list(qs.values())), atol=1e-12)
    np.testing.assert_allclose(got["cold"], np.quantile(cold, list(qs.values())), atol=1e-12)
    mid = {r.k: r.m for r in M.upper_median(df, ["k"], "v", "m").collect()}
    assert mid == {"hot": sorted(hot)[len(hot) // 2], "cold": sorted(cold)[3]}


def test_right_closed_bins(spark):
    vals = [0.0, 0.1, 30.0, 30.0001, 100.0, 100.1, None]
    df = mk(spark, [(v,) for v in vals], "v double")
    got = [r.b for r in df.select(M.right_closed_bin(F.col("v"), [0, 30, 40, 50, 60, 70, 100]).alias("b")).collect()]
    assert got == [None, 0, 0, 1, 5, None, None]


def test_readiness(spark):
    df = mk(spark, [(True, True), (True, None), (False, None)], "a boolean, b boolean")
    got = [r.v for r in df.select(M.readiness({"a": F.col("a"), "b": F.col("b")}).alias("v")).collect()]
    assert got == ["READY", "BORDERLINE", "NOT READY"]


def test_open_positions_free_the_slot_first(spark):
    t = pd.Timestamp("2024-01-01")
    h = pd.Timedelta(hours=1)
    df = mk(spark, 
        [("k", t, t + h), ("k", t + h, t + 3 * h), ("k", t + 2 * h, None)], "k string, entry_ts timestamp, exit_ts timestamp"
    )
    got = P.open_positions(df, ["k"], F.lit(10)).orderBy("ts").collect()
    assert [(r.open_count, r.capital) for r in got] == [(1, 10.0), (1, 10.0), (2, 20.0)]


@pytest.mark.parametrize("block", [2, 256])
def test_correlation_matrix(spark, block):
    rng = np.random.default_rng(3)
    recs = [
        (s, pd.Timestamp("2024-01-01") + pd.Timedelta(days=int(d)), float(rng.normal()))
        for s in ("a", "b", "c") for d in rng.choice(50, 30, replace=False)
    ] + [("z", pd.Timestamp("2024-01-01"), 0.0)]
    df = mk(spark, recs, "s string, entry_ts timestamp, pnl double")
    got = {(r.setup_a, r.setup_b): r.corr for r in P.correlations(df, "s", F.col("pnl"), block).collect()}
    wide = pd.DataFrame(recs, columns=["s", "d", "p"]).pivot_table(index="d", columns="s", values="p", fill_value=0.0)
    for (a, b), c in got.items():
        if "z" in (a, b):
            assert c is None
        else:
            assert c == pytest.approx(wide[a].corr(wide[b]))
    assert len(got) == 6


def test_signature(spark):
    docs = [
        '{"strategy": "fffd", "fee": 0.1, "symbol": "X", "dev": 2.0, "strict": true, "entry": {"thr": 0.50, "fast": 3.0, "kind": "a\\"b"}}',
        '{"exit": {"r": 1.5}, "strategy": "ma", "filter": {"tf": "4h", "thr": -70.0, "kind": "rsi"}}',
        "{}",
    ]
    got = [r[0] for r in mk(spark, [(d,) for d in docs], "d string").select(R.config_signature(F.col("d"))).collect()]
    assert got == [
        'fffd|{"dev":2,"entry":{"fast":3,"kind":"a\\"b","thr":0.5},"strategy":"fffd","strict":true}',
        'ma|{"exit":{"r":1.5},"filter":{"kind":"rsi","tf":"4h","thr":-70},"strategy":"ma"}',
        "None|{}",
    ]


def test_signatures_tell_every_key_apart(spark):
    import json

    base = {
        "strategy": "vwap", "mode": "revert", "band_k": 2.0, "wait_bars": 3, "vol_mult": 1.5, "tol": 0.1, "wick_k": 2, "confirm_bars": 1,
        "window": "open", "intraday_only": True, "exit": {"kind": "r", "max_bars": 40, "r": 2}, "filter": {"ind": "rsi", "thr": 55.5},
        "gates": [{"ind": "adx", "thr": 20}, 1, "a"], "odd \"key\"": None, "list": [1.0, 2], "far": {"x": {"y": [[0.25]]}},
    }
    docs = [base]
    for k, v in base.items():
        docs.append({n: w for n, w in base.items() if n != k})
        docs.append(base | {k: "other"})
        if isinstance(v, dict):
            docs += [base | {k: v | {n: "other"}} for n in v]
    docs += [base | {"gates": base["gates"][::-1]}, base | {"list": [1, 2, 2]}, base | {"list": [2, 1]}, base | {"list": "[1,2]"}]
    docs += [base | {"far": {"x": {"y": [[0.5]]}}}, base | {"wait_bars": "3"}, base | {"intraday_only": "true"}]
    texts = [json.dumps(d) for d in docs] + ["{bad", "{worse", '{"a": 1, "a": 2}', '{"a": 1, "a": 3}', "[1]"]
    sig = lambda rows: [r[0] for r in mk(spark, [(d,) for d in rows], "d string").select(R.config_signature(F.col("d"))).collect()]
    got = sig(texts)
    assert len(set(got)) == len(texts) and None not in got
    swapped = {k: (dict(reversed(v.items())) if isinstance(v, dict) else v) for k, v in reversed(base.items())}
    same = json.dumps(swapped | {"symbol": "X", "fee": 0.1}).replace("55.5", "5.55e1").replace(": 3", ": 3.00").replace(": 40", ": 4e1")
    assert sig([same, json.dumps({"a": 1e-4, "b": 1000})]) == [got[0], sig(['{"b": 1e3, "a": 0.0001}'])[0]]


def test_total_loss_stays(spark):
    df = mk(spark, [("A", 0.1), ("A", -1.0), ("A", 0.2), ("B", 0.1), ("B", 0.2), ("C", -1.5)], "s string, ret double")
    got = {r[0]: r[1] for r in df.groupBy("s").agg(M.compounded_pct(F.col("ret"))).collect()}
    assert got["A"] == -100 and got["C"] == -100 and got["B"] == pytest.approx(32)


def test_shared_folder_off_one_process(spark):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_short_series_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        lake.replace_series(spark.range(5), str(tmp_path / "x"))
    lake.replace_series(spark.range(5), str(tmp_path / "x"), min_rows=5)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 5


def test_plateau_edges(spark):
    w = [3, 5, 8, 13]
    recs = [("A", 3, 5, 40, 1.5), ("A", 3, 8, 40, 1.2), ("A", 8, 13, 40, 9.0), ("A", 5, 13, 40, None), ("A", 5, 8, 10, 1.3)]
    df = mk(spark, recs, "symbol string, fast int, slow int, n_trades int, profit_factor double")
    got = rows(GR.plateau(df, ["symbol"], w), "fast", "slow")
    # (8, 13) has only a neighbour without a factor; (5, 8) has too few trades but still votes
    assert got == [(3, 5), (3, 8)]


def test_fold_edges(spark):
    t0 = pd.Timestamp("2020-01-01")
    day = pd.Timedelta(days=1)
    at = [0, 119, 120, 149]
    df = mk(spark, [("A", "c", t0 + d * day, 0.1) for d in at], "symbol string, cfg string, entry_ts timestamp, ret double")
    assert V.make_folds(df, ["symbol"]).count() == 1
    got = rows(V.fold_trades(df, ["symbol"]), "entry_ts", "fold", "role")
    assert [(f, role) for _, f, role in got] == [(0, "train"), (0, "train"), (0, "test"), (0, "test")]
    short = df.where(F.col("entry_ts") < F.lit("2020-05-20").cast("timestamp"))
    assert V.make_folds(short, ["symbol"]).count() == 0


def test_bootstrap_needs_ten_days(spark):
    t0 = pd.Timestamp("2020-01-01")
    recs = [("short", t0 + pd.Timedelta(days=i), 1.0) for i in range(9)]
    recs += [("long", t0 + pd.Timedelta(days=i), 1.0) for i in range(12)]
    df = mk(spark, recs, "k string, day timestamp, pnl double")
    paths = RB.block_paths(df, "k", n_sims=30).collect()
    assert {(r.k, r.total, r.dd) for r in paths} == {("long", 12.0, 0.0)}
    assert sorted(r.sim for r in paths) == list(range(30))
