"""As-of alignment and bounded range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import US_PER_SECOND, add_tf

SIX_HOURS = 6 * 3600


def asof_many(
    probe: DataFrame,
    sides: Sequence[tuple[DataFrame, str, dict[str, str]]],
    keys: Sequence[str] = ("symbol",),
    probe_ts: str = "ts",
    direction: str = "backward",
    allow_equal: bool = True,
    width: int = SIX_HOURS,
) -> DataFrame:
    """Attach to each probe row the nearest row before (or after) it from every value table.

    ``sides`` holds (values, value_ts, {value column: output name}). All tables are merged and sorted
    once inside (key, time bucket), and each bucket starts from the last value of the buckets before
    it; that carry table has one row per key and bucket. Value timestamps are unique per key and table.
    """
    keys = list(keys)
    sign = 1 if direction == "backward" else -1
    value_side, probe_side = (0, 1) if allow_equal else (1, 0)

    def place(df: DataFrame, ts: str, side: int, name: str, payload: Column) -> DataFrame:
        t = F.unix_micros(F.col(ts)) * F.lit(sign)
        return df.select(
            *keys,
            t.alias("_t"),
            F.floor(t / F.lit(width * US_PER_SECOND)).alias("_b"),
            F.lit(side).alias("_side"),
            payload.alias(name),
        )

    merged = place(probe, probe_ts, probe_side, "_p", F.struct(*probe.columns))
    names = [f"_v{i}" for i in range(len(sides))]
    for v, (values, value_ts, cols) in zip(names, sides):
        payload = F.struct(*[F.col(c).alias(n) for c, n in cols.items()])
        merged = merged.unionByName(
            place(values, value_ts, value_side, v, payload), allowMissingColumns=True
        )
    # one aggregate per column keeps the partial aggregation hash-based
    newest = []
    for v, (_, _, cols) in zip(names, sides):
        at = F.when(F.col(v).isNotNull(), F.col("_t"))
        newest.append(F.max(at).alias(f"_t{v}"))
        newest += [F.max_by(F.col(v)[n], at).alias(f"{v}_{i}") for i, n in enumerate(cols.values())]
    rows = [
        F.when(
            F.col(f"_t{v}").isNotNull(),
            F.struct(*[F.col(f"{v}_{i}").alias(n) for i, n in enumerate(cols.values())]),
        )
        for v, (_, _, cols) in zip(names, sides)
    ]
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        merged.groupBy(*keys, "_b")
        .agg(*newest)
        .select(
            *keys, "_b", *[F.last(x, ignorenulls=True).over(before).alias(f"_c{v}") for v, x in zip(names, rows)]
        )
    )
    inside = (
        Window.partitionBy(*keys, "_b")
        .orderBy("_t", "_side")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = (
        merged.withColumns({f"_l{v}": F.last(v, ignorenulls=True).over(inside) for v in names})
        .where(F.col("_p").isNotNull())
        .join(carry, [*keys, "_b"], "left")
    )
    out = []
    for v, (_, _, cols) in zip(names, sides):
        hit = F.coalesce(F.col(f"_l{v}"), F.col(f"_c{v}"))
        out += [hit[n].alias(n) for n in cols.values()]
    return found.select("_p.*", *out)


def asof(
    probe: DataFrame,
    values: DataFrame,
    keys: Sequence[str] = ("symbol",),
    probe_ts: str = "ts",
    value_ts: str = "ts",
    cols: dict[str, str] | None = None,
    direction: str = "backward",
    allow_equal: bool = True,
    width: int = SIX_HOURS,
) -> DataFrame:
    """``asof_many`` with one value table; ``cols`` maps value column -> output name."""
    cols = cols or {c: c for c in values.columns if c not in (*keys, value_ts)}
    return asof_many(probe, [(values, value_ts, cols)], keys, probe_ts, direction, allow_equal, width)


def visible_at_close(df: DataFrame, tf: str | Column, ts: str = "ts", name: str = "seen_at") -> DataFrame:
    """A bar labelled by its left edge is known only when it has closed."""
    return df.withColumn(name, add_tf(F.col(ts), tf))


def align_setup(
    exec_bars: DataFrame, setup: DataFrame, tf: str, cols: dict[str, str], width: int = SIX_HOURS
) -> DataFrame:
    """Look-ahead-safe setup values on execution bars."""
    return asof(
        exec_bars, visible_at_close(setup, tf), value_ts="seen_at", cols=cols, width=width
    )


def align_setups(
    exec_bars: DataFrame, setups: Sequence[tuple[DataFrame, str, dict[str, str]]], width: int = SIX_HOURS
) -> DataFrame:
    """Several timeframes at once: ``setups`` holds (frame, tf, columns)."""
    sides = [(visible_at_close(df, tf), "seen_at", cols) for df, tf, cols in setups]
    return asof_many(exec_bars, sides, width=width)


def activate(
    events: DataFrame, exec_bars: DataFrame, tf: str | Column, cols: dict[str, str], width: int = SIX_HOURS
) -> DataFrame:
    """First execution bar at or after the setup bar's close; events past the end drop out."""
    hit = asof(
        visible_at_close(events, tf),
        exec_bars,
        probe_ts="seen_at",
        cols=cols,
        direction="forward",
        width=width,
    )
    return hit.where(F.col(next(iter(cols.values()))).isNotNull()).drop("seen_at")


def span_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    lo: Column,
    hi: Column,
    seq: str,
    width: int,
    how: str = "inner",
) -> DataFrame:
    """Join every left row to the right rows with lo <= seq <= hi.

    Spans become one row per ``width``-row bucket they touch, so the join is an equality join on
    (key, bucket) with a range condition, never a nested loop. ``how="left"`` keeps spans without a
    match, once per touched bucket.
    """
    keys = list(keys)
    first, last = F.floor(F.col("_lo") / F.lit(width)), F.floor(F.col("_hi") / F.lit(width))
    spread = (
        left.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .where(F.col("_hi") >= F.col("_lo"))
        .withColumn("_bk", F.explode(F.sequence(first, last)))
        .alias("l")
    )
    bucketed = right.withColumn("_bk", F.floor(F.col(seq) / F.lit(width))).alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*keys, "_bk")]
    on.append(F.col(f"r.{seq}").between(F.col("l._lo"), F.col("l._hi")))
    kept = [F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return spread.join(bucketed, on, how).select(*kept)
