"""Queries over result tables that are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.catalog.base import query, rd, sql
from tapeloom.catalog.metrics import GROUP_COLS, group_columns, pf_sql
from tapeloom.functions.columns import ntz, r
from tapeloom.operators import metrics as M
from tapeloom.session import scratch_path
from tapeloom.sources import results as RS
from tapeloom.sources.tables import runs, trades

PER_FILE = 10_000


@query(
    "registry_get",
    sql("runs", "SELECT run_id, symbol, created_at, sweep_tag, strategy, metric FROM runs WHERE run_id IN (SELECT max(run_id) FROM runs GROUP BY sweep_tag)"),
)
def registry_get(spark, sf):
    """The newest run of each sweep, looked up by id in the sorted registry."""
    path = scratch_path(spark, "registry")
    table = runs(spark, sf)
    RS.write_sorted(table, path, "run_id", PER_FILE)
    newest = [x[0] for x in table.groupBy("sweep_tag").agg(F.max("run_id")).select("max(run_id)").collect()]  # one per sweep
    found = RS.get(spark, path, "run_id", newest)
    return found.select("run_id", "symbol", ntz(F.col("created_at")).alias("created_at"), "sweep_tag", "strategy", "metric")


@query(
    "sweep_sink",
    sql("trades", f"SELECT symbol, cfg, {GROUP_COLS} FROM trades WHERE cfg <> 'AF' OR side = 'long' GROUP BY 1, 2"),
)
def sweep_sink(spark, sf):
    """Statistics of all setups as a table by setup; a later run of one setup replaces its partition alone."""
    path = scratch_path(spark, "sweep")
    t = trades(spark, sf)
    stats = lambda d: d.groupBy("symbol", "cfg").agg(*group_columns())
    RS.replace_partitions(stats(t), path, "cfg")
    RS.replace_partitions(stats(t.where("cfg = 'AF' and side = 'long'")), path, "cfg")
    back = spark.read.option("basePath", path).parquet(path)
    return back.select("symbol", F.col("cfg").cast("string").alias("cfg"), "n", "win_rate", "pf", "avg_ret_pct")


REPORT = "cfg, count(*) AS n, " + rd(pf_sql()) + " AS profit_factor"


@query("report_sink", sql("trades", f"SELECT 'json' AS form, {REPORT} FROM trades GROUP BY cfg UNION ALL SELECT 'markdown', {REPORT} FROM trades GROUP BY cfg"))
def report_sink(spark, sf):
    """A report written as JSON lines and as a Markdown table, both read back."""
    path = scratch_path(spark, "report")
    rows = trades(spark, sf).groupBy("cfg").agg(F.count(F.lit(1)).alias("n"), r(M.profit_factor(F.col("ret"))).alias("profit_factor"))
    RS.write_report(rows, path, "Setups", "cfg")
    json = spark.read.schema(rows.schema).json(f"{path}/json").select(F.lit("json").alias("form"), *rows.columns)
    cells = F.split(F.col("value"), r" \| ")
    text = spark.read.text(f"{path}/markdown").withColumn("value", F.regexp_replace("value", r"^\| | \|$", ""))
    fields = [F.nullif(cells[i], F.lit("-")).cast(f.dataType).alias(f.name) for i, f in enumerate(rows.schema.fields)]
    return json.unionByName(text.select(F.lit("markdown").alias("form"), *fields))
