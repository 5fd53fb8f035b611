"""Result tables: a registry laid out for point lookups, partitions replaced one by one, and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of one file
LAKE_ROWS = 1_000_000


def write_sorted(rows: DataFrame, path: str, key: str, per_file: int = LAKE_ROWS) -> None:
    """Files that each hold one range of ``key``, sorted, so that statistics of files and row groups skip the rest."""
    files = max(1, -(-rows.count() // per_file))
    rows.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def get(spark: SparkSession, path: str, key: str, values: Sequence) -> DataFrame:
    """Rows whose ``key`` is one of a few values; the comparison reaches the scan."""
    return spark.read.parquet(path).where(F.col(key).isin(list(values)))


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write ``rows`` over the partitions they have; the other partitions stay. A task that runs again writes the same files."""
    rows.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str, title: str, key: str) -> None:
    """A report as JSON lines and as Markdown, one line per row; the order of lines is that of ``key``."""
    ordered = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    ordered.write.mode("overwrite").json(f"{path}/json")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns]), F.lit(" |"))
    head = [f"# {title}", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    ordered.select(cells.alias("value")).write.mode("overwrite").text(f"{path}/markdown")
    rows.sparkSession.createDataFrame([(line,) for line in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown-head")
