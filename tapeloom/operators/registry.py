"""Run registry, roster and ranking tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import finite, magnitude_bucket
from tapeloom.operators.metrics import quantiles, upper_median
from tapeloom.operators.quality import keep_last
from tapeloom.operators.series import number_rows


#: strings, numbers and what stands between them in a JSON text
TOKENS = r'"[^"\\]*(?:\\.[^"\\]*)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'
#: keys of a setup document that are no parameters of the setup
OUTSIDE = ("symbol", "fee")


def _plain_number(t: Column) -> Column:
    """A double of a JSON text as a decimal number, where that loses nothing."""
    plain = F.coalesce(*(F.when(d.cast("double") == t.cast("double"), d.cast("string")) for d in (t.try_cast("decimal(38,18)"), t.try_cast("decimal(38,0)"))), t)
    return F.when(t.rlike(r"^-?[0-9]+\.[0-9]*0$|^-?[0-9.]+E"), F.regexp_replace(plain, r"^(-?[0-9]+(?:\.[0-9]*[1-9])?)\.?0*$", "$1")).otherwise(t)


def config_signature(params: Column) -> Column:
    """Strategy and canonical document: all keys but symbol and fee, names sorted, whole numbers without a fraction.

    Values of any kind and depth stay. A text that is no JSON object, or repeats a name, stands for itself.
    """
    doc = F.from_json(params, "map<string,variant>")

    def entry(e: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.regexp_replace(e["key"], r'(["\\])', r"\\$1"), F.lit('":'))
        text = F.coalesce(F.to_json(e["value"]), F.lit("null"))
        plain = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKENS), 0), _plain_number), "")
        return F.struct(e["key"].alias("key"), F.concat(quoted, F.when(text.rlike(r"[0-9]E|\.[0-9]*0"), plain).otherwise(text)).alias("text"))

    entries = F.transform(F.filter(F.map_entries(doc), lambda e: ~e["key"].isin(*OUTSIDE)), entry)
    whole = F.concat(F.lit("{"), F.array_join(F.array_sort(entries)["text"], ","), F.lit("}"))
    names = F.map_keys(doc)
    strategy = F.variant_get(doc["strategy"], "$", "string")
    return F.concat_ws("|", F.coalesce(strategy, F.lit("None")), F.coalesce(F.when(F.size(names) == F.size(F.array_distinct(names)), whole), params))


def run_id(sig: Column, symbol: Column, fee: Column) -> Column:
    """Stable id, so a repeated evaluation replaces its earlier row."""
    return F.substring(F.md5(F.concat_ws("|", F.lit("league"), sig, symbol.cast("string"), fee.cast("string"))), 1, 12)


def clean_metrics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key of an append-only table."""
    return keep_last(df, list(key), list(order))


def append_missing(current: DataFrame, imported: DataFrame, key: Sequence[str]) -> DataFrame:
    """Import legacy rows the registry does not hold yet."""
    return current.unionByName(imported.join(current, list(key), "left_anti"))


def replace_by_key(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keep documents that were not evaluated again, add the new ones."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """New values win where given; missing ones keep what was stored."""
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols])
    joined = old.select(key, *cols).join(n, key, "full")
    return joined.select(key, *[F.coalesce(f"_n_{c}", c).alias(c) for c in cols])


def best_per(df: DataFrame, key: Sequence[str], by: Sequence[Column], k: int = 1) -> DataFrame:
    """Top ``k`` rows per key; Spark limits each partition before it shuffles."""
    w = Window.partitionBy(*key).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_desc(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str) -> DataFrame:
    """Dense position by falling value, for groups of any size: ranks come from value buckets."""
    ranked = df.withColumn("_neg", -F.col(value))
    return (
        number_rows(ranked, keys, ["_neg", tie], magnitude_bucket(F.col("_neg"), 64), "_r")
        .withColumn(name, F.col("_r") + 1)
        .drop("_neg", "_r")
    )


def family_score(runs: DataFrame, min_trades: int = 30, min_pf: float = 1.1, top: int = 50) -> DataFrame:
    """Cheapest-fee row per (family, symbol); families by viable symbols, then median profit factor."""
    rest = F.struct("n_trades", "profit_factor")
    cheapest = runs.groupBy("family", "symbol").agg(F.min_by(rest, F.struct("fee", "run_id")).alias("r"))
    viable = cheapest.select("family", "symbol", "r.*").where(
        (F.col("n_trades") >= min_trades) & (F.col("profit_factor") >= min_pf)
    )
    count = viable.groupBy("family").agg(F.count(F.lit(1)).alias("n_viable"))
    median = quantiles(viable, ["family"], "profit_factor", {"median_pf": 0.5})
    return count.join(median, "family").orderBy(F.desc("n_viable"), F.desc("median_pf"), "family").limit(top)


def candidates(runs: DataFrame, min_pf: float = 1.05, min_symbols: int = 8) -> DataFrame:
    """Families whose upper-median profit factor and symbol count pass."""
    mid = upper_median(runs, ["family"], "profit_factor", "upper_median_pf")
    pairs = runs.select("family", "symbol").distinct().groupBy("family").agg(F.count(F.lit(1)).alias("symbols"))
    return mid.join(pairs, "family").where(
        (F.col("upper_median_pf") > min_pf) & (F.col("symbols") >= min_symbols)
    )


def fee_pivot(runs: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per setup with its results at the lowest and highest fee."""
    row = F.struct("profit_factor", "n_trades", "win_rate_pct")
    return (
        runs.groupBy(*key)
        .agg(
            F.min_by(row, F.struct("fee", "run_id")).alias("lo"),
            F.max_by(row, F.struct("fee", "run_id")).alias("hi"),
            F.min("profit_factor").alias("min_pf"),
            F.count(F.lit(1)).alias("runs"),
        )
        .select(
            *key,
            F.col("lo.profit_factor").alias("low_fee_pf"),
            F.col("hi.profit_factor").alias("high_fee_pf"),
            "min_pf",
            "runs",
            F.floor(F.col("lo.n_trades") * F.col("lo.win_rate_pct") / 100 + 0.5).alias("implied_wins"),
        )
    )


def sync_roster(runs: DataFrame, roster: DataFrame, cap: int) -> DataFrame:
    """Best setup per symbol, at most ``cap`` symbols per setup; everything else is switched off."""
    best = best_per(runs, ["symbol"], [F.desc("profit_factor"), F.col("run_id")])
    kept = best_per(best.drop("rank"), ["family"], [F.desc("profit_factor"), F.col("symbol")], cap)
    chosen = kept.select("symbol", F.col("family").alias("cfg"), F.lit(True).alias("enabled"))
    stale = roster.join(chosen, "symbol", "left_anti").select("symbol", "cfg", F.lit(False).alias("enabled"))
    return chosen.unionByName(stale)


def pinned_top(setups: DataFrame, n: int = 15) -> DataFrame:
    """Favourites first, then the best ``n`` others by profit factor."""
    others = setups.where(~F.col("is_fav")).orderBy(F.desc("profit_factor"), "key").limit(n)
    return setups.where("is_fav").unionByName(others)
