"""Cross-asset league: every configuration on every symbol, train against holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.columns import add_tf, div
from tapeloom.operators import metrics as M
from tapeloom.operators.metrics import INF, pf_of
from tapeloom.operators.registry import rank_desc

# Assets a configuration must trade in the holdout to be ranked.
MIN_ASSETS = {"all": 5, "stock": 5, "crypto": 3}
MIN_HOLD_TRADES = 30


def cutoff(trades: DataFrame, holdout_days: int) -> Column:
    return add_tf(trades.agg(F.max("entry_ts")).scalar(), "1d", -holdout_days)


def _sums(prefix: str, usd: Column) -> list[Column]:
    return [
        F.count(usd).alias(f"{prefix}_n"),
        F.coalesce(F.sum(usd), F.lit(0.0)).alias(f"{prefix}_sum"),
        F.coalesce(F.sum(usd * usd), F.lit(0.0)).alias(f"{prefix}_sq"),
        M.wins(usd).alias(f"{prefix}_win"),
        M.losses(usd).alias(f"{prefix}_loss"),
    ]


def per_asset(trades: DataFrame, cut: Column) -> DataFrame:
    """Step one: sums per (sig, symbol); ``usd`` is the trade's result, ``asset_class`` its class."""
    hold = F.col("entry_ts") >= cut
    return trades.groupBy("sig", "symbol", "asset_class").agg(
        *_sums("train", F.when(~hold, F.col("usd"))), *_sums("hold", F.when(hold, F.col("usd")))
    )


def _sharpe(prefix: str) -> Column:
    n, s, q = F.col(f"{prefix}_n"), F.col(f"{prefix}_sum"), F.col(f"{prefix}_sq")
    var = div(q - div(s * s, n), n - 1)
    return F.round(div(div(s, n), F.sqrt(F.when((n >= 2) & (var > 0), var))), 3)


def roll_up(assets: DataFrame, min_hold_trades: int = MIN_HOLD_TRADES) -> DataFrame:
    """Step two: per sig over all assets and per class, in one grouping-sets pass."""
    good = (F.col("hold_n") >= 3) & (pf_of(F.col("hold_win"), F.col("hold_loss"), "inf_or_null") > 1)
    names = [f"{p}_{c}" for p in ("train", "hold") for c in ("n", "sum", "sq", "win", "loss")]
    rolled = assets.groupingSets([["sig"], ["sig", "asset_class"]], "sig", "asset_class").agg(
        *[F.sum(c).alias(c) for c in names],
        F.count_if(F.col("hold_n") >= 3).alias("hold_assets"),
        F.count_if(good).alias("hold_assets_pf_gt1"),
        F.count(F.lit(1)).alias("assets_logged"),
    )
    out = rolled.withColumn("asset_class", F.coalesce("asset_class", F.lit("all")))
    need = F.lit(None).cast("int")
    for cls, n in MIN_ASSETS.items():
        need = F.when(F.col("asset_class") == cls, n).otherwise(need)
    return out.select(
        "sig",
        "asset_class",
        "assets_logged",
        F.col("train_n").alias("train_trades"),
        pf_of(F.col("train_win"), F.col("train_loss"), "inf_or_null").alias("train_pf"),
        F.col("train_sum").alias("train_pnl_usd"),
        _sharpe("train").alias("train_sharpe"),
        F.col("hold_n").alias("hold_trades"),
        pf_of(F.col("hold_win"), F.col("hold_loss"), "inf_or_null").alias("hold_pf"),
        F.col("hold_sum").alias("hold_pnl_usd"),
        _sharpe("hold").alias("hold_sharpe"),
        "hold_assets",
        "hold_assets_pf_gt1",
        ((F.col("hold_n") >= min_hold_trades) & (F.col("hold_assets") >= need)).alias("eligible"),
    )


def post_discovery(trades: DataFrame, first_seen: DataFrame) -> DataFrame:
    """Only trades entered after the configuration first appeared."""
    late = trades.join(first_seen, "sig").where(F.col("entry_ts") >= F.col("first_seen"))
    usd = F.col("usd")
    stats = late.groupBy("sig").agg(
        F.count(F.lit(1)).alias("post_trades"),
        M.profit_factor(usd, "inf_or_null").alias("post_pf"),
        F.sum(usd).alias("post_pnl_usd"),
    )
    return first_seen.select("sig").join(stats, "sig", "left").withColumns(
        {"post_trades": F.coalesce("post_trades", F.lit(0)), "post_pnl_usd": F.coalesce("post_pnl_usd", F.lit(0.0))}
    )


def merge_store(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Keep first_seen, count rounds, take fresh statistics where a configuration was tested again."""
    fresh = new.select("sig", F.col("hold_pf").alias("_pf"), F.lit(True).alias("_new"))
    both = old.join(fresh, "sig", "full")
    tested = F.coalesce("_new", F.lit(False))
    return both.select(
        "sig",
        F.coalesce("first_seen", now).alias("first_seen"),
        (F.coalesce("rounds_tested", F.lit(0)) + F.when(tested, 1).otherwise(0)).alias("rounds_tested"),
        F.when(tested, F.col("_pf")).otherwise(F.col("hold_pf")).alias("hold_pf"),
    )


def ranked(stats: DataFrame) -> DataFrame:
    """Position among eligible configurations with a finite holdout factor, per class; NULL for others."""
    able = stats.where(F.col("eligible") & (F.col("hold_pf") < INF))
    ranks = rank_desc(
        able.withColumn("_pf", F.round("hold_pf", 9)), ["asset_class"], "_pf", "sig", "rank"
    ).select("sig", "asset_class", "rank")
    return stats.join(ranks, ["sig", "asset_class"], "left")


def keepers(stats: DataFrame, favourites: DataFrame, max_rank: int = 60) -> DataFrame:
    """Configurations near the top of any class, or favoured by the user."""
    return ranked(stats).where(F.col("rank") <= max_rank).select("sig").union(favourites.select("sig")).distinct()


def prune(registry: DataFrame, keep: DataFrame) -> DataFrame:
    """Registry rows to delete."""
    return registry.join(keep, "sig", "left_anti")


def new_leader(stats: DataFrame, known: DataFrame, floor: float = 1.1) -> DataFrame:
    """Best eligible configuration not seen before, flagged when it beats the previous best."""
    able = stats.where(F.col("eligible") & (F.col("hold_pf") < INF)).withColumn("_pf", F.round("hold_pf", 9))
    previous = able.join(known, "sig", "left_semi").agg(F.max("_pf").alias("m"))
    fresh = able.join(known, "sig", "left_anti")
    best = fresh.groupBy().agg(F.max(F.struct("_pf", "sig")).alias("b"))
    bar = F.greatest(previous.scalar(), F.lit(floor))
    return best.where(F.col("b").isNotNull()).select(
        F.col("b.sig").alias("sig"), F.col("b._pf").alias("hold_pf"), (F.col("b._pf") > bar).alias("is_leader")
    )
