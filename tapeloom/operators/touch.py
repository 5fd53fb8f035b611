"""First bar that reaches a level, found on a tree of extremes.

A key's bars are numbered without gaps. Level 0 of the tree holds blocks of ``FAN`` bars, one row per block with the
values as arrays; every further level holds the least value of each block below. A probe looks for the first position
after its own: inside its block, else among the later blocks of each level, then down again. Every step is one
equality join with at most one matching row, so the work does not depend on how far away the touch is, nothing is
fanned out, and no window spans a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 64


def extremes(bars: DataFrame, lanes: dict[str, Column], keys: Sequence[str], carry: Sequence[str] = (), fan: int = FAN) -> list[DataFrame]:
    """Levels of the tree: keys, ``_block`` and an array per lane; level 0 also holds the ``carry`` columns' values.

    A lane is touched where its value is at or below a level. NULL values are never touched.
    """
    keys, top = list(keys), (bars.agg(F.max("bar_no")).first()[0] or 0) // fan
    names = [f"_l{i}" for i in range(len(lanes))]
    rows = bars.select(*keys, F.col("bar_no").alias("_no"), *[c.cast("double").alias(n) for n, c in zip(names, lanes.values(), strict=True)], *carry)
    levels, kept = [], [*names, *carry]
    while True:
        whole = rows.withColumn("_block", F.floor(F.col("_no") / F.lit(fan)))
        # at most ``fan`` rows of a block
        packed = whole.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("_no", *kept))).alias("_r"), *[F.min(n).alias(f"_m{n}") for n in names])
        levels.append(packed.select(*keys, "_block", *[F.col("_r")[n].alias(n) for n in kept]))
        if not top:
            return levels
        rows, kept = packed.select(*keys, F.col("_block").alias("_no"), *[F.col(f"_m{n}").alias(n) for n in names]), names
        top //= fan


def first_touch(
    probes: DataFrame, bars: DataFrame, lanes: dict[str, Column], keys: Sequence[str] = ("symbol",), carry: Sequence[str] = (), fan: int = FAN
) -> DataFrame:
    """``probes`` with ``touch_no``, the first ``bar_no`` above ``after`` whose ``lane`` value is at or below ``level``.

    ``probes`` has the key columns, ``after``, ``lane`` (a name in ``lanes``) and ``level``; ``carry`` columns of the
    touched bar come along. Rows without a touch keep NULLs. Bars are numbered from 0 without gaps per key.
    """
    keys, tree = list(keys), extremes(bars, lanes, keys, carry, fan)
    lane_no = F.coalesce(*[F.when(F.col("lane") == name, F.lit(i)) for i, name in enumerate(lanes)])
    # _node: position to look behind on the current level; _at: the level on which a node was found
    spread = -1 - F.pmod(F.hash(*keys, "after", "level"), F.lit(1009)).cast("long")
    out = probes.withColumns({"_lane": lane_no, "_node": F.col("after").cast("long"), "_hit": F.lit(None).cast("long"), "_at": F.lit(None).cast("int"), "_spread": spread})
    out = out.withColumns({c: F.lit(None).cast(bars.schema[c].dataType) for c in carry})

    def look(df: DataFrame, level: int, block: Column, behind: Column, active: Column, found_at: int) -> DataFrame:
        own = tree[level].select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block"), *[c for c in tree[level].columns if c.startswith("_l")], *([F.col(c).alias(f"_c_{c}") for c in carry] if level == 0 else []))
        on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.when(active, block).otherwise(F.col("_spread")) == F.col("_block")]
        values = F.coalesce(*[F.when(F.col("_lane") == i, F.col(f"_l{i}")) for i in range(len(lanes))])
        marked = F.transform(values, lambda x, i: (i > behind) & F.coalesce(x <= F.col("level"), F.lit(False)))
        place = F.coalesce(F.array_position(marked, F.lit(True)), F.lit(0))
        df = df.join(own, on, "left").withColumn("_place", place)
        found = F.col("_place") > 0
        new = {"_hit": F.when(found, F.col("_block") * fan + F.col("_place") - 1).otherwise(F.col("_hit")), "_at": F.when(found, F.lit(found_at)).otherwise(F.col("_at"))}
        if level == 0:
            new |= {c: F.when(found, F.element_at(f"_c_{c}", F.greatest(F.col("_place"), F.lit(1)).cast("int"))).otherwise(F.col(c)) for c in carry}
        return df.withColumns(new).drop(*[c for c in own.columns], "_place")

    for level in range(len(tree)):
        block = F.floor(F.col("_node") / F.lit(fan))
        out = look(out, level, block, F.col("_node") - block * fan, F.col("_hit").isNull(), level)
        out = out.withColumn("_node", block)
    for level in range(len(tree) - 1, 0, -1):
        out = look(out, level - 1, F.col("_hit"), F.lit(-1), F.col("_at") == level, level - 1)
    return out.withColumnRenamed("_hit", "touch_no").drop("_lane", "_node", "_at", "_spread")
