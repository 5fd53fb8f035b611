"""Result tables: sorted registry, partitions replaced one by one, reports."""

from pyspark.sql import functions as F

from tapeloom.session import scratch_path
from tapeloom.sources import results as RS


def test_lookup_reaches_the_scan_and_one_file(spark):
    path = scratch_path(spark, "registry")
    df = spark.range(1000).select(F.col("id").alias("run_id"), (F.col("id") * 2).alias("metric")).repartition(7)
    RS.write_sorted(df, path, "run_id", 100)
    got = RS.get(spark, path, "run_id", [431])
    assert [tuple(r) for r in got.collect()] == [(431, 862)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "431" in plan.split("PushedFilters: [")[1].split("]")[0]
    ranges = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("run_id").alias("lo"), F.max("run_id").alias("hi")).collect()
    assert len(ranges) > 5 and sum(r.lo <= 431 <= r.hi for r in ranges) == 1


def test_replacing_a_partition_leaves_the_others(spark):
    path = scratch_path(spark, "sweep")
    schema = "cfg string, n int"
    RS.replace_partitions(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema), path, "cfg")
    for _ in range(2):  # a run that is repeated changes nothing
        RS.replace_partitions(spark.createDataFrame([("a", 9)], schema), path, "cfg")
    assert sorted((r.cfg, r.n) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]


def test_report_round_trip(spark):
    path = scratch_path(spark, "report")
    rows = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "cfg string, n int, pf double")
    RS.write_report(rows, path, "Setups", "cfg")
    assert sorted(spark.read.schema(rows.schema).json(f"{path}/json").collect()) == sorted(rows.collect(), key=lambda r: r.cfg)
    lines = {r.value for r in spark.read.text(f"{path}/markdown").collect()}
    assert lines == {"| a | 1 | 0.5 |", "| b | 2 | - |"}
