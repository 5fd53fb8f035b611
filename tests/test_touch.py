"""First touches on the tree of extremes, and what the sweeps build on them."""

import numpy as np
import pandas as pd
import pytest
from helpers import random_bars, to_spark
from pyspark.sql import functions as F

from tapeloom.operators.touch import extremes, first_touch
from tapeloom.plans import configs as C
from tapeloom.plans import robustness as RB
from tapeloom.plans import sweep as SW


@pytest.mark.parametrize("n,fan", [(300, 4), (300, 64), (5, 4), (1, 8)])
def test_first_touch_equals_a_scan(spark, n, fan):
    bars = random_bars(n, seed=n)
    bars.loc[bars.index % 17 == 3, "low"] = np.nan
    df = to_spark(spark, bars)
    moves = [0.002, 0.03, 0.2]
    lanes = {"low": F.nullif(F.col("low"), F.lit(float("nan"))), "high": -F.col("high")}
    steps = F.array(*[F.struct(F.lit(lane).alias("lane"), F.lit(m).alias("m")) for lane in lanes for m in moves])
    probes = df.withColumn("_x", F.explode(steps)).select("symbol", F.col("bar_no").alias("after"), "close", "_x.*")
    level = F.when(F.col("lane") == "low", F.col("close") * (1 - F.col("m"))).otherwise(-F.col("close") * (1 + F.col("m")))
    got = first_touch(probes.withColumn("level", level), df, lanes, carry=["open"], fan=fan).collect()
    assert len(got) == 6 * len(bars)
    by = {s: g.sort_values("bar_no").reset_index(drop=True) for s, g in bars.groupby("symbol")}
    for r in got:
        g = by[r.symbol]
        hit = g.low <= r.level if r.lane == "low" else -g.high <= r.level
        at = g.bar_no[hit & (g.bar_no > r.after)]
        want = None if at.empty else int(at.iloc[0])
        assert r.touch_no == want and (want is None or r.open == g.open[want])


def test_tree_blocks_are_bounded(spark):
    tree = extremes(to_spark(spark, random_bars(300)), {"low": F.col("low")}, ["symbol"], fan=4)
    assert len(tree) == 5
    assert all(t.select(F.max(F.size("_l0"))).first()[0] <= 4 for t in tree)


def test_crosses_alternate_and_skip_zero(spark):
    """Windows 1 and 2: touching equality is no cross until the other sign appears."""
    close = [10, 11, 11, 12, 12, 11, 11, 11, 10, 12]
    bars = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-03-01", periods=10, freq="15min"), "bar_no": range(10)})
    for c in ("open", "high", "low", "close"):
        bars[c] = np.array(close, float)
    bars["volume"] = 1.0
    got = SW.ma_crosses(to_spark(spark, bars), [1, 2]).where("combo = 0").orderBy("bar_no").collect()
    # rising at 1 and 3 is one state, falling begins at 5, rising again at 9
    assert [(r.bar_no, r.dir, r.next_no) for r in got] == [(5, -1, 9), (9, 1, None)]


def test_lab_grid_and_labels():
    grid = C.lab_grid("15min", [0.001, 0.0025])
    assert len(grid) == 112 and len({C.label(c) for c in grid}) == 56
    assert C.label(grid[0]) == "orb 15min · range_min 15 · exit sl=0.005 tp=0.005"


def test_paths_equal_a_walk(spark):
    """The matrix of paths against one block after another."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=37)
    days = pd.DataFrame({"k": "a", "day": pd.date_range("2024-01-01", periods=37), "pnl": x})
    got = {r.sim: (r.total, r.dd) for r in RB.block_paths(spark.createDataFrame(days), "k", n_sims=60, batch=7).collect()}
    for sim in range(60):
        path, slot = [], 0
        while len(path) < 37:
            start = (RB.LCG_A * (sim * 1000003 + slot * 7919 + 12345) + RB.LCG_C) % RB.LCG_M % 37
            path += list(x[start : start + 5])
            slot += 1
        cum = np.cumsum(path[:37])
        want = (cum[-1], min(0.0, (cum - np.maximum(np.maximum.accumulate(cum), 0)).min()))
        assert got[sim] == pytest.approx(want)
