"""Order-dependent steps that keep a hot key spread over many tasks.

A plain window over ``symbol`` sorts a symbol's whole history in one task. The helpers here
cut each key into time buckets or fixed-length row chunks, work inside those, and pass only one
small summary row per bucket along the key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions.columns import US_PER_SECOND, known

CHUNK = 2048
DAY = 86400
# exp(-42) is below double precision; exp(650) stays far from overflow
HALO_EXPONENT = 42.0
MAX_EXPONENT = 650.0
Stage = dict[str, Callable[[WindowSpec], Column]]


def time_bucket(ts: str | Column, seconds: int = DAY) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col) / F.lit(seconds * US_PER_SECOND))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = "bar_no",
) -> DataFrame:
    """Zero-based position within each key; ``bucket`` must not decrease along ``order``."""
    keys = list(keys)
    tagged = df.withColumn("_b", bucket)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        tagged.withColumn("_i", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_b"])
        .withColumn(name, F.col("_i") + F.col("_off"))
        .drop("_b", "_i", "_off")
    )


def rolling(
    df: DataFrame,
    back: int,
    *stages: Stage,
    ahead: int = 0,
    keys: Sequence[str] = ("symbol",),
    seq: str = "bar_no",
    chunk: int = CHUNK,
) -> DataFrame:
    """Add windowed columns that look at most ``back`` rows behind and ``ahead`` rows forward.

    Rows go to chunk ``seq // chunk``; the rows near an edge are also copied into the neighbour
    chunk, so every frame is complete without a window over the whole key. ``back`` is the sum
    of the lookbacks of all stages.
    """
    chunk = max(chunk, back + 1, ahead + 1)
    pos = F.col(seq)
    home = F.floor(pos / F.lit(chunk))
    offset = F.pmod(pos, F.lit(chunk))
    copies = [home]
    if back:
        copies.append(F.when(offset >= chunk - back, home + 1))
    if ahead:
        copies.append(F.when((offset < ahead) & (home > 0), home - 1))
    out = df.withColumn("_home", home)
    if len(copies) > 1:
        out = out.withColumn("_chunk", F.explode(F.array_compact(F.array(*copies))))
    else:
        out = out.withColumn("_chunk", F.col("_home"))
    out = out.withColumn("_base", F.col("_chunk") * F.lit(chunk))
    spec = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    for stage in stages:
        out = out.withColumns({name: make(spec) for name, make in stage.items()})
    return out.where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home", "_base")


def full_avg(value: str | Column, n: int, seq: str = "bar_no") -> Callable[[WindowSpec], Column]:
    """Mean of the last ``n`` rows, NULL until ``n`` rows exist."""
    return lambda w: F.when(F.col(seq) >= n - 1, F.avg(value).over(w.rowsBetween(-(n - 1), 0)))


def full_agg(
    agg: Callable[[Column], Column], value: str, n: int, end: int = 0, seq: str = "bar_no"
) -> Callable[[WindowSpec], Column]:
    """Any aggregate over ``n`` rows ending ``-end`` rows ago, NULL until the frame is full."""
    return lambda w: F.when(
        F.col(seq) >= n - 1 - end, agg(F.col(value)).over(w.rowsBetween(-(n - 1) + end, end))
    )


def lag(value: str | Column, k: int = 1) -> Callable[[WindowSpec], Column]:
    return lambda w: F.lag(value, k).over(w)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``/``max``/``min``/``count``/``last`` along a key, in two levels.

    Level one runs inside each (key, bucket); level two carries one row per bucket.
    """
    keys = list(keys)
    cols = {f"_v{i}": (name, kind, col) for i, (name, (kind, col)) in enumerate(specs.items())}
    tagged = df.withColumn("_b", bucket).withColumns({v: c for v, (_, _, c) in cols.items()})
    order_key = F.struct(*order)

    def whole(v: str, kind: str) -> Column:
        if kind == "last":
            return F.max_by(v, F.when(F.col(v).isNotNull(), order_key))
        return getattr(F, kind)(v)

    def window_of(v: str, kind: str, w: WindowSpec, again: bool) -> Column:
        if kind == "last":
            return F.last(v, ignorenulls=True).over(w)
        return getattr(F, "sum" if again and kind == "count" else kind)(v).over(w)

    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    summary = tagged.groupBy(*keys, "_b").agg(*[whole(v, k).alias(v) for v, (_, k, _) in cols.items()])
    carry = summary.select(
        *keys, "_b", *[window_of(v, k, before, True).alias(f"_c{v}") for v, (_, k, _) in cols.items()]
    )
    inside = (
        Window.partitionBy(*keys, "_b")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    out = tagged.withColumns({f"_i{v}": window_of(v, k, inside, False) for v, (_, k, _) in cols.items()})
    out = out.join(carry, [*keys, "_b"])
    merged = {}
    for v, (name, kind, _) in cols.items():
        here, prior = F.col(f"_i{v}"), F.col(f"_c{v}")
        if kind in ("sum", "count"):
            both = F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
            merged[name] = F.when(here.isNotNull() | prior.isNotNull(), both)
        elif kind == "last":
            merged[name] = F.coalesce(here, prior)
        else:
            merged[name] = (F.greatest if kind == "max" else F.least)(here, prior)
    helpers = ["_b", *cols, *[f"_i{v}" for v in cols], *[f"_c{v}" for v in cols]]
    return out.withColumns(merged).drop(*helpers)


@dataclass(frozen=True)
class Step:
    """Columns that look ``back`` rows behind; ``rate`` is the steepest exponential decay per row."""

    back: int
    stage: Stage
    rate: float = 0.0


def chain(df: DataFrame, *steps: Step, keys: Sequence[str] = ("symbol",), seq: str = "bar_no") -> DataFrame:
    """Run dependent steps in one chunked pass when their lookbacks fit, else in several."""
    total = sum(s.back for s in steps)
    rate = max(s.rate for s in steps)
    chunk = max(CHUNK, 4 * total)
    if rate:
        chunk = min(chunk, int(MAX_EXPONENT / rate) - total)
    if chunk < total and len(steps) > 1:
        return chain(chain(df, *steps[:-1], keys=keys, seq=seq), steps[-1], keys=keys, seq=seq)
    return rolling(df, total, *[s.stage for s in steps], keys=keys, seq=seq, chunk=chunk)


def ewm_step(
    values: dict[str, tuple[Column, float]], first: Column | int = 0, seq: str = "bar_no"
) -> Step:
    """Recursive exponential means y0=x0, y=alpha*x+(1-alpha)*y[-1]; values are (column, alpha).

    Inside a chunk the recursion is a weighted running sum. Rows further back than the halo weigh less
    than 1e-18, so a chunk with its halo gives the same doubles as the whole series. ``first`` is the
    position where the series starts; earlier rows stay NULL.
    """
    pos, start = F.col(seq), F.lit(first) if isinstance(first, int) else first
    offset = (pos - F.col("_base")).cast("double")
    stage, back, steepest = {}, 1, 0.0
    for name, (value, alpha) in values.items():
        started = known(pos >= start)
        if alpha >= 1.0:
            stage[name] = lambda w, v=value, on=started: F.when(on, v)
            continue
        rate = -math.log(1.0 - alpha)
        weight = F.when(known(pos == start), 1.0).when(started, alpha).otherwise(0.0)
        term = weight * F.coalesce(value, F.lit(0.0)) * F.exp(offset * rate)
        stage[name] = lambda w, t=term, r=rate, on=started: F.when(
            on, F.exp(-offset * r) * F.sum(t).over(w.rowsBetween(Window.unboundedPreceding, 0))
        )
        back, steepest = max(back, math.ceil(HALO_EXPONENT / rate)), max(steepest, rate)
    return Step(back, stage, steepest)


def ema_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def ema(df: DataFrame, value: str, span: int, name: str, **kw) -> DataFrame:
    return chain(df, ewm_step({name: (F.col(value), ema_alpha(span))}), **kw)
