"""Walk-forward folds: winners by brute force, and how the rows are dealt to tasks."""

import numpy as np
import pandas as pd
import pytest
from helpers import mk
from pyspark.sql import functions as F

from tapeloom.plans import validate as V

KEY = ["symbol"]


@pytest.fixture(scope="module")
def trades(spark):
    rng = np.random.default_rng(3)
    t0 = pd.Timestamp("2024-01-01 09:30")
    recs = []
    for s in range(12):
        for _ in range(300):
            cfg = [None, "a", "b", "c"][int(rng.integers(0, 4))]
            ret = None if rng.random() < 0.02 else float(rng.integers(-5, 6)) / 100
            recs.append((s, cfg, t0 + pd.Timedelta(minutes=int(rng.integers(0, 400 * 1440))), ret))
    recs.append((None, "a", t0, 0.01))
    return mk(spark, recs, "symbol long, cfg string, entry_ts timestamp, ret double")


def brute(trades, min_train):
    t = trades.toPandas()
    out = {}
    for s, g in t[t.symbol.notna()].groupby("symbol"):
        t0, t1 = g.entry_ts.min(), g.entry_ts.max()
        fold = 0
        while t0 + pd.Timedelta(days=30 * fold + 150) <= t1 + pd.Timedelta(days=1):
            start = t0 + pd.Timedelta(days=30 * fold)
            train = g[(g.entry_ts >= start) & (g.entry_ts < start + pd.Timedelta(days=120)) & g.ret.notna()]
            ranked = []
            for cfg, x in train.groupby("cfg", dropna=False):
                won, lost = x.ret[x.ret > 0].sum(), -x.ret[x.ret < 0].sum()
                pf = won / lost if lost > 0 else 1e308 if won > 0 else 0.0
                if len(x) >= min_train:
                    none = pd.isna(cfg)
                    ranked.append((-round(pf, 9), -round(x.ret.mean(), 9), none, "" if none else cfg, len(x)))
            if ranked:
                _, _, none, cfg, n = min(ranked)
                out[int(s), fold] = (None, None) if none else (cfg, n)
            fold += 1
    return out


@pytest.mark.parametrize("per_task", [100, 100_000])
def test_winners(spark, trades, monkeypatch, per_task):
    monkeypatch.setattr(V, "PER_TASK", per_task, raising=False)
    w = V.select_winners(V.fold_stats(trades, KEY, "cfg"), KEY, "cfg", 4)
    assert w.columns == ["symbol", "fold", "winner", "train_n", "train_pf", "test_n", "test_pf"]
    assert {(r.symbol, r.fold): (r.winner, r.train_n) for r in w.collect()} == brute(trades, 4)


def test_winners_are_ranked_where_the_statistics_lie(spark, trades):
    """One exchange for the trades, the others for the spans, which have a row per key; no struct in a sort aggregate."""
    stats = V.fold_stats(trades, KEY, "cfg")
    before, after = (d._jdf.queryExecution().executedPlan().toString() for d in (stats, V.select_winners(stats, KEY, "cfg", 4)))
    assert after.count("Exchange") == before.count("Exchange")
    assert "SortAggregate" not in after and after.count("Join") == before.count("Join")


def test_tasks_grow_with_the_trades(spark, trades, monkeypatch):
    """Adaptive execution merges partitions of this size into one, unless their number is given."""
    monkeypatch.setattr(V, "PER_TASK", 100, raising=False)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(threshold)
    # a table this small would be broadcast
    spark.conf.set(threshold, "-1")
    picks = V.select_winners(V.fold_stats(trades, KEY, "cfg"), KEY, "cfg", 1)
    try:
        for df in (V.tested_trades(trades, KEY), V.stitched(trades, picks, KEY, "cfg"), V.fold_stats(trades, KEY, "cfg")):
            per_task = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert len(per_task) >= 6 and max(per_task) <= sum(per_task) / 2
    finally:
        spark.conf.set(threshold, was)
