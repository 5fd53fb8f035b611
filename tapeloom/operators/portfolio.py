"""Views over many trades at once: open positions, sectors, calendars, correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import NEW_YORK, div, local
from tapeloom.operators.metrics import daily_sums
from tapeloom.operators.series import DAY, number_rows, prefix_scan, time_bucket
from tapeloom.session import stage


def open_positions(trades: DataFrame, keys: Sequence[str], size: Column) -> DataFrame:
    """Positions and committed capital after each instant with an entry.

    Entries add, exits subtract, and an exit at an instant frees its slot before entries of that
    instant. Changes are summed per instant before they are accumulated.
    """
    keys = list(keys)
    size = size.cast("double")
    enter = trades.select(*keys, F.col("entry_ts").alias("ts"), F.lit(1).alias("n"), size.alias("cap"), F.lit(1).alias("entered"))
    leave = trades.where(F.col("exit_ts").isNotNull()).select(
        *keys, F.col("exit_ts").alias("ts"), F.lit(-1).alias("n"), (-size).alias("cap"), F.lit(0).alias("entered")
    )
    change = (
        enter.unionByName(leave)
        .groupBy(*keys, "ts")
        .agg(F.sum("n").alias("n"), F.sum("cap").alias("cap"), F.sum("entered").alias("entered"))
    )
    run = prefix_scan(
        change,
        keys,
        ["ts"],
        time_bucket("ts", DAY),
        {"open_count": ("sum", F.col("n")), "capital": ("sum", F.col("cap"))},
    )
    return run.where(F.col("entered") > 0).select(*keys, "ts", "open_count", "capital", "entered")


def peak_mix(trades: DataFrame, size: Column, group: str) -> DataFrame:
    """What the book held, per group, at the first moment of highest committed capital."""
    run = open_positions(trades.withColumn("_all", F.lit(0)), ["_all"], size)
    peak = run.agg(F.min_by("ts", F.struct(-F.col("capital"), F.col("ts")))).scalar()
    held = trades.where((F.col("entry_ts") <= peak) & (F.col("exit_ts") > peak))
    return held.groupBy(group).agg(F.count(F.lit(1)).alias("open_count"))


def iso_week(ts: Column, tz: str = NEW_YORK) -> tuple[Column, Column]:
    wall = local(ts, tz)
    return F.extract(F.lit("YEAROFWEEK"), wall).cast("long"), F.weekofyear(wall).cast("long")


def weekly_ledger(trades: DataFrame, pnl: Column, size: Column, start: float, tz: str = NEW_YORK) -> DataFrame:
    """ISO-week table with concurrency and a bankroll carried week to week (one row per week)."""
    year, week = iso_week(F.col("entry_ts"), tz)
    base = trades.groupBy(year.alias("iso_year"), week.alias("iso_week")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(pnl).alias("pnl"), F.count_if(pnl > 0).alias("wins")
    )
    run = open_positions(trades.withColumn("_all", F.lit(0)), ["_all"], size)
    y2, w2 = iso_week(F.col("ts"), tz)
    peaks = run.groupBy(y2.alias("iso_year"), w2.alias("iso_week")).agg(
        F.max("open_count").alias("max_open"), F.max("capital").alias("peak_capital")
    )
    order = Window.partitionBy(F.lit(0)).orderBy("iso_year", "iso_week").rowsBetween(Window.unboundedPreceding, 0)
    return (
        base.join(peaks, ["iso_year", "iso_week"])
        .withColumn("end_balance", F.lit(start) + F.sum("pnl").over(order))
        .withColumn("start_balance", F.col("end_balance") - F.col("pnl"))
        .withColumn("ret_pct", div(F.col("pnl") * 100, F.col("start_balance")))
    )


def dense_daily(trades: DataFrame, setup: str, pnl: Column) -> DataFrame:
    """Daily P&L of every setup on every day any setup traded; zero where it did not.

    Each setup row expands to the list of days in place; the time span bounds that list.
    """
    daily = daily_sums(trades, [setup], pnl)
    days = daily.select("day").distinct().agg(F.array_sort(F.collect_list("day"))).scalar()
    grid = daily.select(setup).distinct().withColumn("day", F.explode(days))
    return grid.join(daily, ["day", setup], "left").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))


def correlations(trades: DataFrame, setup: str, pnl: Column, block: int = 256) -> DataFrame:
    """Pearson correlation of daily P&L for each pair of setups, absent days counting as zero.

    Setups are cut into blocks. Blocks of one day meet pairwise, and tasks add up block products over
    the days, so a day's setup pairs are never written out as rows and no task holds all setups.
    """
    daily = daily_sums(trades, [setup], pnl)
    named = daily.select(setup).distinct().withColumn("_h", F.xxhash64(setup)).withColumn("_all", F.lit(0))
    index = stage(
        number_rows(named, ["_all"], ["_h", setup], F.shiftright("_h", 48), "_pos").select(
            setup, F.col("_pos").alias("_i")
        ),
        "setups",
    )
    placed = daily.join(index, setup).withColumn("_b", F.floor(F.col("_i") / F.lit(block)))
    vectors = placed.groupBy("day", "_b").agg(
        F.collect_list(F.struct(F.pmod("_i", F.lit(block)).cast("int").alias("at"), "pnl")).alias("v")
    )
    left = vectors.select("day", F.col("_b").alias("p"), F.col("v").alias("x"))
    right = vectors.select("day", F.col("_b").alias("q"), F.col("v").alias("y"))
    meet = left.join(right, "day").where("p <= q").repartition("p", "q")

    def dense(column: pd.Series) -> np.ndarray:
        m = np.zeros((len(column), block))
        for row, items in enumerate(column):
            for it in items:
                m[row, it["at"]] = it["pnl"]
        return m

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for pair, g in batch.groupby(["p", "q"]):
                part = dense(g["x"]).T @ dense(g["y"])
                total[pair] = total[pair] + part if pair in total else part
        for (p, q), m in total.items():
            i, j = np.indices(m.shape)
            i, j, v = i.ravel() + p * block, j.ravel() + q * block, m.ravel()
            keep = (i <= j) & ((v != 0) | (i < j))
            yield pd.DataFrame({"i": i[keep], "j": j[keep], "sxy": v[keep]})

    cells = meet.mapInPandas(products, "i long, j long, sxy double").groupBy("i", "j").agg(F.sum("sxy").alias("sxy"))
    sums = placed.groupBy("_i", setup).agg(F.sum("pnl").alias("_s"), F.sum(F.col("pnl") * F.col("pnl")).alias("_ss"))
    a = sums.select(F.col("_i").alias("i"), F.col(setup).alias("setup_a"), F.col("_s").alias("sa"), F.col("_ss").alias("saa"))
    b = sums.select(F.col("_i").alias("j"), F.col(setup).alias("setup_b"), F.col("_s").alias("sb"), F.col("_ss").alias("sbb"))
    n = daily.select("day").distinct().agg(F.count(F.lit(1))).scalar()
    cov = F.col("sxy") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    corr = div(cov, F.sqrt(F.when((va > 0) & (vb > 0), va * vb)))
    flip = F.col("setup_a") > F.col("setup_b")
    return (
        cells.where("i < j")
        .join(a, "i")
        .join(b, "j")
        .select(
            F.when(flip, F.col("setup_b")).otherwise(F.col("setup_a")).alias("setup_a"),
            F.when(flip, F.col("setup_a")).otherwise(F.col("setup_b")).alias("setup_b"),
            corr.alias("corr"),
        )
    )


def top_share(trades: DataFrame, keys: Sequence[str], pnl: str, k: int = 10) -> DataFrame:
    """Share of gross profit made by the ``k`` largest winners."""
    won = trades.where(F.col(pnl) > 0).select(*keys, pnl)
    best = Window.partitionBy(*keys).orderBy(F.desc(pnl))
    top = (
        won.withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= k)
        .groupBy(*keys)
        .agg(F.sum(pnl).alias("_top"))
    )
    gross = won.groupBy(*keys).agg(F.sum(pnl).alias("_gross"))
    return gross.join(top, list(keys)).select(*keys, div(F.col("_top"), F.col("_gross")).alias("top_share"))
