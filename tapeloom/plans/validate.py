"""Walk-forward validation on closed trades ``(symbol, cfg, entry_ts, ret)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import div
from tapeloom.operators import metrics as M

DAY_US = 86_400_000_000
# training and test lengths are whole steps
TRAIN_DAYS, TEST_DAYS, STEP_DAYS = 120, 30, 30
# trades a task gets; the number of tasks grows with the table, so a task's memory does not
PER_TASK = 100_000


def _tasks(trades: DataFrame) -> int:
    return max(1, -(-trades.count() // PER_TASK))


def _with_spans(trades: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """Each trade with the span of its key. Both sides are dealt by key to ``tasks`` tasks; later steps on the keys stay there."""
    return trades.repartition(tasks, *keys).join(spans(trades, keys).repartition(tasks, *keys), list(keys))


def spans(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First entry and number of whole folds that fit, per key."""
    us = F.unix_micros("entry_ts")
    room = F.max(us) + DAY_US - F.min(us) - (TRAIN_DAYS + TEST_DAYS) * DAY_US
    folds = F.when(room >= 0, F.floor(room / F.lit(STEP_DAYS * DAY_US)) + 1).otherwise(0)
    return trades.groupBy(*keys).agg(F.min(us).alias("start_us"), folds.alias("n_folds"))


def make_folds(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rolling folds: train, then test, moved one step at a time while the test window fits."""
    each = (
        spans(trades, keys)
        .where(F.col("n_folds") > 0)
        .withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_folds") - 1)))
    )
    start = F.col("start_us") + F.col("fold") * F.lit(STEP_DAYS * DAY_US)
    return each.select(
        *keys,
        "fold",
        F.timestamp_micros(start).alias("train_start"),
        F.timestamp_micros(start + TRAIN_DAYS * DAY_US).alias("train_end"),
        F.timestamp_micros(start + (TRAIN_DAYS + TEST_DAYS) * DAY_US).alias("test_end"),
    )


def _slot() -> Column:
    """Number of whole steps since the first entry of the key; every fold edge is a slot edge."""
    return F.floor((F.unix_micros("entry_ts") - F.col("start_us")) / F.lit(STEP_DAYS * DAY_US))


def _roles(df: DataFrame) -> DataFrame:
    """Rows with ``slot`` once per fold window they fall into: four training folds and one test fold."""
    k = F.explode(F.array(*[F.lit(i) for i in range((TRAIN_DAYS + TEST_DAYS) // STEP_DAYS)]))
    role = F.when(F.col("_k") < TRAIN_DAYS // STEP_DAYS, "train").otherwise("test")
    return (
        df.withColumn("_k", k)
        .withColumn("fold", F.col("slot") - F.col("_k"))
        .where((F.col("fold") >= 0) & (F.col("fold") < F.col("n_folds")))
        .withColumn("role", role)
        .drop("_k", "slot", "start_us", "n_folds")
    )


def fold_trades(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each trade once per fold window it falls into, by arithmetic on its entry time; no range join."""
    return _roles(trades.join(spans(trades, keys), list(keys)).withColumn("slot", _slot()))


def tested_trades(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each trade with the one fold whose test window holds it."""
    return _tested(trades, keys, _tasks(trades))


def _tested(trades: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    placed = _with_spans(trades, keys, tasks).withColumn("fold", _slot() - TRAIN_DAYS // STEP_DAYS)
    return placed.where((F.col("fold") >= 0) & (F.col("fold") < F.col("n_folds"))).drop("start_us", "n_folds")


def fold_stats(trades: DataFrame, keys: Sequence[str], cfg: str) -> DataFrame:
    """Train and test statistics per fold and configuration.

    Trades are summed per slot first; folds then combine slot sums, so the shuffle never carries a trade
    once per fold.
    """
    ret = F.col("ret")
    slots = (
        _with_spans(trades, keys, _tasks(trades))
        .groupBy(*keys, cfg, _slot().alias("slot"), "n_folds")
        .agg(F.count(ret).alias("n"), F.sum(ret).alias("s"), M.wins(ret).alias("w"), M.losses(ret).alias("l"))
    )

    def part(role: str, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("role") == role, F.col(c))), F.lit(0))

    sums = _roles(slots.withColumn("start_us", F.lit(0))).groupBy(*keys, "fold", cfg).agg(
        *[part(role, c).alias(f"_{role}_{c}") for role in ("train", "test") for c in ("n", "s", "w", "l")]
    )
    out = []
    for role in ("train", "test"):
        n, total = F.col(f"_{role}_n"), F.col(f"_{role}_s")
        out += [
            n.alias(f"{role}_n"),
            M.pf_of(F.col(f"_{role}_w"), F.col(f"_{role}_l"), "inf_or_zero").alias(f"{role}_pf"),
            div(total, n).alias(f"{role}_mean"),
        ]
    return sums.select(*keys, "fold", cfg, *out)


def select_winners(stats: DataFrame, keys: Sequence[str], cfg: str, min_train: int) -> DataFrame:
    """Per fold the configuration with the best training profit factor, then mean; ties by name.

    Scores are compared at nine digits, so the order of summation cannot pick the winner. Rows dealt by key, as
    :func:`fold_stats` leaves them, are ranked where they are.
    """
    best = Window.partitionBy(*keys, "fold").orderBy(
        F.round("train_pf", 9).desc(), F.round("train_mean", 9).desc(), F.col(cfg).asc_nulls_last()
    )
    top = stats.where(F.col("train_n") >= min_train).withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    # a winner without a name has no figures
    named = [F.when(F.col(cfg).isNotNull(), F.col(c)).alias(c) for c in ("train_n", "train_pf", "test_n", "test_pf")]
    return top.select(*keys, "fold", F.col(cfg).alias("winner"), *named)


def stitched(trades: DataFrame, winners: DataFrame, keys: Sequence[str], cfg: str) -> DataFrame:
    """The winners' trades in their test windows: the out-of-sample record.

    A key's winners travel as one map from fold to name, so the trades are dealt once, by key.
    """
    tasks = _tasks(trades)
    names = F.map_from_entries(F.collect_list(F.struct("fold", "winner"))).alias("_winners")
    picks = winners.groupBy(*keys).agg(names).repartition(tasks, *keys)
    tested = _tested(trades, keys, tasks).join(picks, list(keys))
    return tested.where(F.col("_winners")[F.col("fold")] == F.col(cfg)).drop("_winners")
