"""Registry, roster, ranking and dimension queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import query, rd, sql
from tapeloom.catalog.metrics import pf_sql
from tapeloom.functions.columns import finite, ntz, r
from tapeloom.operators import metrics as M
from tapeloom.operators import registry as R
from tapeloom.operators.metrics import INF
from tapeloom.sources.tables import runs, table, trades

FAM = "fam AS (SELECT *, sweep_tag || '|' || strategy AS family, CAST(run_id % 101 AS DOUBLE) AS win_rate_pct, 2 * profit_factor AS pf2 FROM runs)"


def family_runs(spark, sf):
    return runs(spark, sf).withColumns(
        {
            "family": F.concat_ws("|", "sweep_tag", "strategy"),
            "win_rate_pct": F.pmod("run_id", F.lit(101)).cast("double"),
            "pf2": F.col("profit_factor") * 2,
        }
    )


CFG = (
    "SELECT run_id, strategy || '|{{\"dev\":' || (run_id % 3) || CASE WHEN run_id % 2 = 0 THEN '.5' ELSE '' END || ',\"entry\":{{\"fast\":' || (run_id % 7) || ',\"kind\":\"ma_cross\",\"thr\":0.5}},\"exit\":{{\"kind\":\"r\",\"r\":' || (run_id % 4) || '}}' || CASE WHEN run_id % 5 = 0 THEN ',\"filter\":{{\"kind\":\"rsi\",\"tf\":\"4h\",\"thr\":55}}' ELSE '' END || ',"
    "\"setup_tf\":\"4h\",\"strategy\":\"' || strategy || '\"}}' AS sig FROM runs"
).replace("{{", "{").replace("}}", "}")


@query("config_sig", sql("runs", CFG))
def config_sig(spark, sf):
    """Free-form parameter documents, keys in arbitrary order, floats where integers are meant."""
    doc = F.format_string(
        '{"fee": %s, "strategy": "%s", "symbol": "%s", "entry": {"thr": 0.5, "kind": "ma_cross", "fast": %s.0}, "dev": %s%s, "setup_tf": "4h", "exit": {"r": %s.0, "kind": "r"}%s}',
        F.col("fee").cast("string"), "strategy", F.col("symbol").cast("string"),
        F.pmod("run_id", F.lit(7)).cast("string"), F.pmod("run_id", F.lit(3)).cast("string"),
        F.when(F.pmod("run_id", F.lit(2)) == 0, ".5").otherwise(".0"), F.pmod("run_id", F.lit(4)).cast("string"),
        F.when(F.pmod("run_id", F.lit(5)) == 0, ', "filter": {"tf": "4h", "thr": 55, "kind": "rsi"}').otherwise(""),
    )
    return runs(spark, sf).select("run_id", R.config_signature(doc).alias("sig"))


@query("run_id_md5", sql("runs", "SELECT run_id, substr(md5('league|' || sweep_tag || '|' || symbol || '|' || fee), 1, 12) AS rid FROM runs"))
def run_id_md5(spark, sf):
    return runs(spark, sf).select("run_id", R.run_id(F.col("sweep_tag"), F.col("symbol"), F.col("fee")).alias("rid"))


@query(
    "registry_latest",
    sql("runs", "SELECT symbol, sweep_tag, max(run_id) FILTER (WHERE true) AS any_id, arg_max(run_id, created_at * 1) AS rid FROM "
        "(SELECT symbol, sweep_tag, run_id, epoch_us(created_at)::HUGEINT * 1000000000000 + run_id AS created_at FROM runs) GROUP BY 1, 2")
    .replace("max(run_id) FILTER (WHERE true) AS any_id, ", ""),
)
def registry_latest(spark, sf):
    return R.latest(
        runs(spark, sf).select("symbol", "sweep_tag", "created_at", F.col("run_id").alias("rid")),
        ["symbol", "sweep_tag"],
        ["created_at", "rid"],
    ).select("symbol", "sweep_tag", "rid")


@query(
    "registry_overview",
    sql("runs", "SELECT sweep_tag, count(*) AS runs, count(DISTINCT symbol) AS symbols, "
        "count(DISTINCT symbol) FILTER (WHERE symbol % 4 = 0) AS crypto_symbols FROM runs GROUP BY 1"),
)
def registry_overview(spark, sf):
    """Runs and distinct symbols per tag; distinct pairs are formed before they are counted."""
    pairs = runs(spark, sf).groupBy("sweep_tag", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("sweep_tag").agg(
        F.sum("n").alias("runs"),
        F.count(F.lit(1)).alias("symbols"),
        F.count_if(F.col("symbol") % 4 == 0).alias("crypto_symbols"),
    )


@query(
    "registry_export",
    sql("runs", "SELECT run_id, '{\"run_id\":' || run_id || ',\"profit_factor\":' || coalesce(CAST(CASE WHEN n_trades > 0 THEN profit_factor END AS VARCHAR), 'null') "
        "|| ',\"params\":{\"tag\":\"' || sweep_tag || '\",\"fee\":' || fee || '}}' AS doc FROM runs"),
)
def registry_export(spark, sf):
    """Strict JSON: non-finite metrics become null, parameters come back as a structure."""
    params = F.to_json(F.struct(F.col("sweep_tag").alias("tag"), "fee"))
    dirty = F.when(F.col("n_trades") > 0, F.col("profit_factor")).otherwise(F.lit(float("nan")))
    doc = F.struct(
        "run_id",
        finite(dirty).alias("profit_factor"),
        F.from_json(params, "tag string, fee double").alias("params"),
    )
    return runs(spark, sf).select("run_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))


@query(
    "merge_replace",
    sql("runs", "o AS (SELECT symbol, max(run_id) AS run_id, 'old' AS src FROM runs WHERE created_at < TIMESTAMP '1999-01-01' GROUP BY 1), "
        "n AS (SELECT symbol, max(run_id) AS run_id, 'new' AS src FROM runs WHERE created_at >= TIMESTAMP '1999-01-01' GROUP BY 1)",
        "SELECT * FROM o WHERE symbol NOT IN (SELECT symbol FROM n) UNION ALL SELECT * FROM n"),
)
def merge_replace(spark, sf):
    def part(cond, src):
        return runs(spark, sf).where(cond).groupBy("symbol").agg(F.max("run_id").alias("run_id")).withColumn("src", F.lit(src))

    old = part(F.col("created_at") < "1999-01-01", "old")
    return R.replace_by_key(old, part(F.col("created_at") >= "1999-01-01", "new"), ["symbol"])


@query(
    "roster_upsert",
    sql("runs", "o AS (SELECT symbol, max(sweep_tag) AS cfg, max(fee) AS size_usd FROM runs WHERE created_at < TIMESTAMP '1998-06-01' GROUP BY 1), "
        "n AS (SELECT symbol, min(CASE WHEN strategy <> 'P' THEN sweep_tag END) AS cfg, CAST(NULL AS DOUBLE) AS size_usd FROM runs WHERE created_at >= TIMESTAMP '1998-06-01' GROUP BY 1)",
        "SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.cfg, o.cfg) AS cfg, coalesce(n.size_usd, o.size_usd) AS size_usd FROM o FULL JOIN n ON n.symbol = o.symbol"),
)
def roster_upsert(spark, sf):
    t = runs(spark, sf)
    old = t.where("created_at < timestamp '1998-06-01'").groupBy("symbol").agg(F.max("sweep_tag").alias("cfg"), F.max("fee").alias("size_usd"))
    new = t.where("created_at >= timestamp '1998-06-01'").groupBy("symbol").agg(
        F.min(F.when(F.col("strategy") != "P", F.col("sweep_tag"))).alias("cfg"), F.lit(None).cast("double").alias("size_usd")
    )
    return R.upsert(old, new, "symbol", ["cfg", "size_usd"])


@query(
    "roster_sync",
    sql("runs", FAM,
        "b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY profit_factor DESC, run_id) AS rn FROM fam WHERE n_trades >= 30), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY profit_factor DESC, symbol) AS rk FROM b WHERE rn = 1), "
        "o AS (SELECT symbol, max(family) AS cfg FROM fam WHERE strategy = 'O' GROUP BY 1)",
        "SELECT symbol, family AS cfg, true AS enabled FROM k WHERE rk <= 20 UNION ALL "
        "SELECT symbol, cfg, false FROM o WHERE symbol NOT IN (SELECT symbol FROM k WHERE rk <= 20)"),
)
def roster_sync(spark, sf):
    f = family_runs(spark, sf)
    roster = f.where("strategy = 'O'").groupBy("symbol").agg(F.max("family").alias("cfg"))
    return R.sync_roster(f.where("n_trades >= 30"), roster, 20)


@query("best_per_symbol", sql("runs", "r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n_trades >= 30 DESC, profit_factor DESC, run_id) AS rn FROM runs WHERE n_trades >= 10)",
       "SELECT symbol, run_id, profit_factor FROM r WHERE rn = 1"))
def best_per_symbol(spark, sf):
    t = runs(spark, sf).where("n_trades >= 10")
    by = [F.desc(F.col("n_trades") >= 30), F.desc("profit_factor"), F.col("run_id")]
    return R.best_per(t, ["symbol"], by).select("symbol", "run_id", "profit_factor")


@query("top3_per_symbol", sql("runs", "r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY profit_factor DESC, run_id) AS rank FROM runs)",
       "SELECT symbol, rank, run_id, profit_factor FROM r WHERE rank <= 3"))
def top3_per_symbol(spark, sf):
    best = R.best_per(runs(spark, sf), ["symbol"], [F.desc("profit_factor"), F.col("run_id")], 3)
    return best.select("symbol", F.col("rank").cast("long").alias("rank"), "run_id", "profit_factor")


@query(
    "family_score",
    sql("runs", FAM,
        "c AS (SELECT *, row_number() OVER (PARTITION BY family, symbol ORDER BY fee, run_id) AS rn FROM fam)",
        f"SELECT family, count(*) AS n_viable, {rd('median(profit_factor)')} AS median_pf FROM c WHERE rn = 1 AND n_trades >= 30 AND profit_factor >= 1.1 "
        "GROUP BY 1 ORDER BY 2 DESC, median(profit_factor) DESC, 1 LIMIT 50"),
)
def family_score(spark, sf):
    s = R.family_score(family_runs(spark, sf))
    return s.select("family", "n_viable", r(F.col("median_pf")).alias("median_pf"))


@query(
    "upper_median",
    sql("runs", FAM,
        "l AS (SELECT family, list_sort(list(profit_factor)) AS pfs, count(DISTINCT symbol) AS symbols FROM fam GROUP BY 1)",
        "SELECT family, pfs[len(pfs) // 2 + 1] AS upper_median_pf, symbols FROM l WHERE pfs[len(pfs) // 2 + 1] > 0.9 AND symbols >= 8"),
)
def upper_median(spark, sf):
    return R.candidates(family_runs(spark, sf), min_pf=0.9)


@query(
    "fee_pivot",
    sql("runs", FAM,
        "k AS (SELECT *, fee * 1e12 + run_id AS o FROM fam)",
        "SELECT symbol, family, arg_min(profit_factor, o) AS low_fee_pf, arg_max(profit_factor, o) AS high_fee_pf, min(profit_factor) AS min_pf, count(*) AS runs, "
        "CAST(floor(arg_min(n_trades, o) * arg_min(win_rate_pct, o) / 100 + 0.5) AS BIGINT) AS implied_wins FROM k GROUP BY 1, 2"),
)
def fee_pivot(spark, sf):
    return R.fee_pivot(family_runs(spark, sf), ["symbol", "family"])


@query("approved_semi", sql("runs", "SELECT run_id, symbol, profit_factor FROM runs WHERE symbol IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"))
def approved_semi(spark, sf):
    approved = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("symbol"))
    return runs(spark, sf).join(approved, "symbol", "left_semi").select("run_id", "symbol", "profit_factor")


@query(
    "journal_feed",
    sql("trades", f"p AS (SELECT cfg, symbol, count(*) AS n, {pf_sql(no_loss='inf_or_zero')} AS pf FROM trades WHERE cfg IN ('AF', 'NO') GROUP BY 1, 2), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY cfg ORDER BY round(pf, 9) DESC, symbol) AS rn FROM p WHERE n >= 5)",
        "SELECT t.cfg, t.symbol, entry_ts, order_id, line_no, part_id, ret FROM trades t JOIN k USING (cfg, symbol) WHERE rn <= 5"),
)
def journal_feed(spark, sf):
    """Trades of the approved setups on their best assets."""
    t = trades(spark, sf).where(F.col("cfg").isin("AF", "NO"))
    stats = t.groupBy("cfg", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(M.profit_factor(F.col("ret"), "inf_or_zero"), 9).alias("pf")
    )
    best = R.best_per(stats.where("n >= 5"), ["cfg"], [F.desc("pf"), F.col("symbol")], 5).select("cfg", "symbol")
    hit = t.join(best, ["cfg", "symbol"], "left_semi")
    return hit.select("cfg", "symbol", ntz(F.col("entry_ts")).alias("entry_ts"), "order_id", "line_no", "part_id", "ret")


@query(
    "runs_filter",
    sql("runs", "SELECT run_id, symbol, CASE WHEN n_trades > 20 THEN profit_factor END AS pf FROM runs WHERE strategy = 'F' AND sweep_tag = '5-LOW' "
        "AND n_trades >= 10 ORDER BY pf DESC NULLS LAST, run_id"),
)
def runs_filter(spark, sf):
    t = runs(spark, sf).where("strategy = 'F' and sweep_tag = '5-LOW' and n_trades >= 10")
    t = t.select("run_id", "symbol", F.when(F.col("n_trades") > 20, F.col("profit_factor")).alias("pf"))
    return t.orderBy(F.desc_nulls_last("pf"), "run_id")


@query("top_runs", sql("runs", "SELECT run_id, metric FROM runs ORDER BY metric DESC, run_id LIMIT 20"))
def top_runs(spark, sf):
    return runs(spark, sf).orderBy(F.desc("metric"), "run_id").limit(20).select("run_id", "metric")


@query(
    "set_ops",
    sql("runs", "a AS (SELECT symbol FROM runs WHERE strategy = 'F'), b AS (SELECT symbol FROM runs WHERE strategy = 'P')",
        "SELECT 'union' AS op, symbol FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'minus', symbol FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"),
)
def set_ops(spark, sf):
    t = runs(spark, sf)
    a, b = t.where("strategy = 'F'").select("symbol"), t.where("strategy = 'P'").select("symbol")
    both = a.union(b).distinct().select(F.lit("union").alias("op"), "symbol")
    return both.union(a.subtract(b).select(F.lit("minus").alias("op"), "symbol"))


@query(
    "sector_dim",
    sql("", "SELECT s_suppkey AS symbol, replace(s_name, '#', '-') AS ticker, coalesce(n_name, 'Other') AS sector, coalesce(r_name, 'Other') AS region, "
        "CASE WHEN s_acctbal >= 5000 THEN 100.0::DOUBLE ELSE 1000.0::DOUBLE END AS size_usd FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey "
        "LEFT JOIN region ON r_regionkey = n_regionkey"),
)
def sector_dim(spark, sf):
    n = table(spark, sf, "nation")
    g = table(spark, sf, "region")
    s = table(spark, sf, "supplier")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(g, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select(
        F.col("s_suppkey").alias("symbol"),
        F.replace("s_name", F.lit("#"), F.lit("-")).alias("ticker"),
        F.coalesce("n_name", F.lit("Other")).alias("sector"),
        F.coalesce("r_name", F.lit("Other")).alias("region"),
        F.when(F.col("s_acctbal") >= 5000, 100.0).otherwise(1000.0).alias("size_usd"),
    )


@query("universe", sql("trades", "SELECT symbol FROM trades UNION SELECT s_suppkey FROM supplier"))
def universe(spark, sf):
    core = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return trades(spark, sf).select("symbol").distinct().union(core).distinct()


@query(
    "pinned_top",
    sql("runs", FAM,
        "w AS (SELECT symbol, family, sum(CAST(floor(n_trades * win_rate_pct / 100 + 0.5) AS BIGINT)) AS wins, max(profit_factor) AS profit_factor FROM fam GROUP BY 1, 2), "
        "m AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY wins DESC, family DESC) AS rn FROM w), "
        "s AS (SELECT symbol || ':' || family AS key, profit_factor, symbol % 50 = 0 AS is_fav FROM m WHERE rn = 1)",
        "SELECT * FROM s WHERE is_fav UNION ALL SELECT * FROM (SELECT * FROM s WHERE NOT is_fav ORDER BY profit_factor DESC, key LIMIT 15)"),
)
def pinned_top(spark, sf):
    f = family_runs(spark, sf)
    won = f.groupBy("symbol", "family").agg(
        F.sum(F.floor(F.col("n_trades") * F.col("win_rate_pct") / 100 + 0.5)).alias("wins"),
        F.max("profit_factor").alias("profit_factor"),
    )
    most = won.groupBy("symbol").agg(F.max_by(F.struct("family", "profit_factor"), F.struct("wins", "family")).alias("b"))
    setups = most.select(
        F.concat_ws(":", F.col("symbol").cast("string"), F.col("b.family")).alias("key"),
        F.col("b.profit_factor").alias("profit_factor"),
        (F.col("symbol") % 50 == 0).alias("is_fav"),
    )
    return R.pinned_top(setups)


@query(
    "registry_import",
    sql("runs", "a AS (SELECT run_id, symbol, 'registry' AS src FROM runs WHERE strategy <> 'P')",
        "SELECT * FROM a UNION ALL SELECT run_id, symbol, 'legacy' FROM runs WHERE run_id NOT IN (SELECT run_id FROM a)"),
)
def registry_import(spark, sf):
    """Legacy rows join the registry only where it lacks them."""
    t = runs(spark, sf).select("run_id", "symbol", "strategy")
    current = t.where("strategy <> 'P'").select("run_id", "symbol", F.lit("registry").alias("src"))
    return R.append_missing(current, t.select("run_id", "symbol", F.lit("legacy").alias("src")), ["run_id"])
