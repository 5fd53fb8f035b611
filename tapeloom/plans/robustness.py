"""Bootstrap and the readiness battery."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.metrics import daily_sums, max_drawdown, profit_factor, readiness
from tapeloom.operators.portfolio import top_share

# The linear congruential generator that draws block starts.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2147483648


def block_paths(daily: DataFrame, key: str, n_sims: int, block: int = 5, batch: int = 200) -> DataFrame:
    """Total and worst drawdown of each resampled path of a setup's daily P&L.

    A setup's series has one number per day, so it travels as one array; the simulations are spread over
    tasks in batches. Setups with fewer than two blocks have no paths.
    """
    series = (
        daily.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("day", "pnl"))).alias("v"))
        .where(F.size("v") >= 2 * block)
        .select(key, F.transform("v", lambda x: x["pnl"]).alias("v"))
    )
    chunks = series.withColumn(
        "sim0", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1), F.lit(batch)))
    ).repartition(key, "sim0")
    key_type = daily.schema[key].dataType.simpleString()

    def paths(x: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals and worst drawdowns of the paths ``sims``, all at once."""
        n, slots = len(x), len(x) // block + 40
        while True:
            seed = (sims[:, None] * 1000003 + np.arange(slots) * 7919 + 12345) % LCG_M
            starts = (LCG_A * seed + LCG_C) % LCG_M % n
            # a block cut off by the end of the series is shorter; the next one follows at once
            sizes = np.minimum(block, n - starts)
            ends = sizes.cumsum(axis=1)
            if (ends[:, -1] >= n).all():
                break
            slots *= 2
        place = np.repeat((starts - ends + sizes).ravel(), sizes.ravel())
        row, all_of = np.repeat(np.arange(len(sims)), ends[:, -1]), ends[:, -1]
        at = np.arange(len(row)) - np.repeat(all_of.cumsum() - all_of, all_of)
        seq = x[(place + at)[at < n].reshape(len(sims), n)]
        cum = seq.cumsum(axis=1)
        fall = cum - np.maximum(np.maximum.accumulate(cum, axis=1), 0.0)
        return seq.sum(axis=1), np.minimum(fall.min(axis=1), 0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, vals, sim0 in zip(b[key], b["v"], b["sim0"]):
                sims = np.arange(sim0, min(sim0 + batch, n_sims), dtype=np.int64)
                total, dd = paths(np.asarray(vals, dtype=float), sims)
                yield pd.DataFrame({key: [k] * len(sims), "sim": sims, "total": total, "dd": dd})

    return chunks.mapInPandas(run, f"{key} {key_type}, sim long, total double, dd double")


def bootstrap_summary(paths: DataFrame, key: str) -> DataFrame:
    """Order statistics of the paths; there are ``n_sims`` rows per setup."""
    by = lambda c: Window.partitionBy(key).orderBy(c, "sim")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    placed = paths.withColumns({"_rt": F.row_number().over(by("total")) - 1, "_rd": F.row_number().over(by("dd")) - 1, "_n": n})

    def q(rank: str, value: str, p: float):
        return F.max(F.when(F.col(rank) == F.floor(F.lit(p) * (F.col("_n") - 1)), F.col(value)))

    return placed.groupBy(key).agg(
        q("_rt", "total", 0.05).alias("p05_total"),
        q("_rt", "total", 0.5).alias("p50_total"),
        q("_rt", "total", 0.95).alias("p95_total"),
        q("_rd", "dd", 0.05).alias("p05_dd"),
        q("_rd", "dd", 0.5).alias("p50_dd"),
        F.avg(F.when(F.round("total", 6) < 0, 1.0).otherwise(0.0)).alias("p_loss"),
    )


def readiness_report(trades: DataFrame, key: str, cut, n_sims: int) -> DataFrame:
    """Six checks per setup on trades with ``pnl`` and ``stressed`` (the same at a multiple of their fees), and the verdict.

    Setups with too few days for a bootstrap are listed with NULL; an unknown check counts as failed.
    """
    hold = F.col("entry_ts") >= cut
    pnl = F.col("pnl")
    daily = daily_sums(trades, [key], pnl)
    base = trades.groupBy(key).agg(
        profit_factor(F.when(~hold, pnl)).alias("train_pf"),
        profit_factor(F.when(hold, pnl)).alias("hold_pf"),
        profit_factor(F.when(hold, F.col("stressed"))).alias("stress_pf"),
    )
    months = trades.groupBy(key, F.date_trunc("month", "entry_ts").alias("m")).agg(F.sum("pnl").alias("p"))
    share = months.groupBy(key).agg(
        F.avg(F.when(F.col("p") > 0, 1.0).otherwise(0.0)).alias("positive_months"),
        F.count_if(F.col("p") > 0).alias("good_months"),
        F.count(F.lit(1)).alias("months"),
        F.min("p").alias("worst_month"),
    )
    paths = block_paths(daily, key, n_sims)
    loss = paths.groupBy(key).agg(F.avg(F.when(F.round("total", 6) < 0, 1.0).otherwise(0.0)).alias("p_loss"))
    out = base.join(share, key).join(loss, key, "left").join(top_share(trades, [key], "pnl"), key, "left").join(max_drawdown(daily, [key]), key)
    return out.withColumn(
        "verdict",
        readiness(
            {
                "train": F.col("train_pf") >= 1.0,
                "hold": F.col("hold_pf") >= 1.1,
                "stress": F.col("stress_pf") >= 1.0,
                "months": F.col("positive_months") >= 0.6,
                "loss": F.col("p_loss") <= 0.25,
                "concentration": F.col("top_share") <= 0.35,
            }
        ),
    )
