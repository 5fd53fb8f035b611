"""Connected components as alternating star contractions on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: two long columns ``a``, ``b``. Returns ``node``, ``component`` (the smallest node reachable).

    Nodes without an edge to another node are left out. Each round hangs the larger neighbours of every
    node on its smallest neighbour, then does the same for the smaller ones; rounds end when the table
    stands still, after about log(longest path) of them. Every round is written to the shared folder, so
    lineage stays short. Minima combine before the shuffle and the joins back are plain equality joins,
    so a node with very many neighbours is split by adaptive execution. Nulls link nothing.
    """
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (
            both.join(low, both.a == low.u)
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        small_low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        joined = large.join(small_low, large.a == small_low.u)
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stage(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
