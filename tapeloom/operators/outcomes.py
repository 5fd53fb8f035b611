"""What happens after an entry: armed breakouts, first-touch exits, trailing stops, single-position
selection, costs and excursions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.columns import MARKET, TIMEFRAMES, add_tf, div, known, local_day, tf_seconds
from tapeloom.operators.asof import asof, span_join
from tapeloom.operators.series import number_rows, rolling
from tapeloom.session import stage

SPAN = 64
MIN_BAR_SECONDS = 60
REASONS = ["stop", "target", "band", "opposite", "eod", "time", "trail"]
SLIPPAGE_BACKTEST = 1e-4
SLIPPAGE_PAPER = 5e-4


def breakout_entries(
    events: DataFrame,
    bars: DataFrame,
    setup_tf: str | Column,
    validity: int = 2,
    same_session: bool = False,
    tz: str = MARKET,
    by: Sequence[str] = (),
) -> DataFrame:
    """Fire an armed level on the first bar that breaks it; ``by`` names configuration columns.

    ``setup_tf`` is one timeframe or a column (made of ``by`` columns) with each signal's own.

    A signal lives from its activation bar to its expiry, cut short by the next signal of the same
    side; so lives of one side never overlap and the first break inside each life is the answer.
    """
    armed = _arm(events.select("symbol", *by, "ts", "dir", "trigger", "stop"), bars, setup_tf, validity, same_session, by, tz)
    # signals activating on one bar: the latest one stays armed
    armed = armed.groupBy("symbol", *by, "dir", "act").agg(
        *[F.max_by(c, "ts").alias(c) for c in ("trigger", "stop", "exp")], F.max("ts").alias("ts")
    )
    # a successor beyond the longest possible life cannot cut it short
    widest = tf_seconds(setup_tf) if isinstance(setup_tf, str) else max(TIMEFRAMES.values())
    longest = (validity + 1) * widest // MIN_BAR_SECONDS
    lives = rolling(
        armed, 0, {"_next": lambda w: F.lead("act").over(w)}, ahead=longest, keys=["symbol", *by, "dir"], seq="act"
    )
    lives = lives.withColumn("_end", F.least(F.col("exp"), F.coalesce(F.col("_next") - 1, F.col("exp"))))
    path = bars.select("symbol", "bar_no", F.col("ts").alias("bar_ts"), "open", "high", "low")
    hits = span_join(lives.drop("_next"), path, ["symbol"], F.col("act"), F.col("_end"), "bar_no", SPAN)
    broke = F.when(F.col("dir") == 1, F.col("high") > F.col("trigger")).otherwise(F.col("low") < F.col("trigger"))
    first = (
        hits.where(broke)
        .groupBy("symbol", *by, "dir", "ts", "trigger", "stop")
        .agg(
            F.min("bar_no").alias("entry_no"),
            F.min_by("bar_ts", "bar_no").alias("entry_ts"),
            F.min_by("open", "bar_no").alias("_open"),
        )
    )
    price = F.when(F.col("dir") == 1, F.greatest("_open", "trigger")).otherwise(F.least("_open", "trigger"))
    return (
        first.withColumn("price", price)
        .withColumn("stop_pct", div((F.col("price") - F.col("stop")) * F.col("dir"), F.col("price")))
        .select(
            "symbol",
            *by,
            F.col("ts").alias("signal_ts"),
            "entry_ts",
            "entry_no",
            "dir",
            "price",
            "stop",
            "stop_pct",
        )
    )


def _arm(
    events: DataFrame, bars: DataFrame, setup_tf: str | Column, validity: int, same_session: bool, by: Sequence[str], tz: str
) -> DataFrame:
    """First (``act``) and last (``exp``) execution bar of each signal's life.

    Activation, expiry and the signal candle itself are probes of one forward as-of pass. With
    ``same_session`` the candle and the activation share a session and the life ends with it.
    """
    probes = [
        F.struct(F.lit("act").alias("what"), add_tf(F.col("ts"), setup_tf).alias("at")),
        F.struct(F.lit("exp").alias("what"), add_tf(F.col("ts"), setup_tf, validity + 1).alias("at")),
    ]
    if same_session:
        probes.append(F.struct(F.lit("sig").alias("what"), F.col("ts").alias("at")))
    tagged = bars.withColumn("_day", local_day(F.col("ts"), tz))
    found = asof(
        events.withColumn("_p", F.explode(F.array(*probes))).select("*", "_p.what", "_p.at").drop("_p"),
        tagged,
        probe_ts="at",
        cols={"bar_no": "_no", "_day": "_day"},
        direction="forward",
    )

    def of(what: str, col: str) -> Column:
        return F.max(F.when(F.col("what") == what, F.col(col)))

    ids = ["symbol", *by, "ts", "dir", "trigger", "stop"]
    last = bars.groupBy("symbol").agg(F.max("bar_no").alias("_last"))
    armed = (
        found.groupBy(*ids)
        .agg(
            of("act", "_no").alias("act"),
            of("exp", "_no").alias("_after"),
            of("act", "_day").alias("_day"),
            of("sig", "_day").alias("_sig_day"),
        )
        .where(F.col("act").isNotNull())
        .join(last, "symbol")
        .withColumn("exp", F.coalesce(F.col("_after") - 1, F.col("_last")))
    )
    if same_session:
        ends = tagged.groupBy("symbol", "_day").agg(F.max("bar_no").alias("_end"))
        armed = (
            armed.where(F.col("_day") == F.col("_sig_day"))
            .join(ends, ["symbol", "_day"])
            .withColumn("exp", F.least("exp", "_end"))
        )
    return armed.select(*ids, "act", "exp")


def fill_price(entries: DataFrame, bars: DataFrame) -> DataFrame:
    """Entries without a price fill at their bar's close."""
    close = bars.select("symbol", F.col("bar_no").alias("entry_no"), F.col("close").alias("_c"))
    return (
        entries.join(close, ["symbol", "entry_no"])
        .withColumn("price", F.coalesce(F.col("price"), F.col("_c")))
        .drop("_c")
    )


def with_barriers(
    entries: DataFrame, sl: Column | float | None = None, tp: Column | float | None = None, r_multiple: float | None = None
) -> DataFrame:
    """Stop and target price levels from fractions of the entry price, or a multiple of the stop distance."""
    side = F.col("dir")

    def level(frac, sign) -> Column:
        if frac is None:
            return F.lit(None).cast("double")
        frac = F.lit(frac) if isinstance(frac, (int, float)) else frac
        return F.col("price") * (1 + sign * side * frac)

    out = entries.withColumn("sl_level", level(sl, -1))
    if r_multiple is not None:
        distance = F.abs(F.col("price") - F.col("sl_level"))
        return out.withColumn("tp_level", F.col("price") + side * distance * r_multiple)
    return out.withColumn("tp_level", level(tp, 1))


def barrier_outcomes(
    entries: DataFrame,
    bars: DataFrame,
    max_bars: int,
    first_bar: int = 1,
    flags: DataFrame | None = None,
) -> DataFrame:
    """Earliest of stop, target, band touch, opposite signal, session end and time exit.

    A stop wins over a target on one bar, and a gap through a level fills at the open. Entries at a
    bar's close are watched from the next bar; ``first_bar=0`` also watches the entry bar, for entries
    filled inside it. ``flags`` may
    add per-bar columns: ``opposite`` (side of a fresh opposite signal), ``eod`` (flat at the close),
    ``band_long``/``band_short`` (moving target levels). Entry rows are distinct.
    """
    path = bars.select("symbol", "bar_no", F.col("ts").alias("bar_ts"), "open", "high", "low", "close")
    extra = []
    if flags is not None:
        extra = [c for c in flags.columns if c not in ("symbol", "bar_no")]
        path = path.join(flags, ["symbol", "bar_no"], "left")
    walk = span_join(
        entries,
        path,
        ["symbol"],
        F.col("entry_no") + first_bar,
        F.col("entry_no") + max_bars,
        "bar_no",
        max(SPAN, max_bars),
        "left",
    )
    is_long = F.col("dir") == 1
    sl, tp = F.col("sl_level"), F.col("tp_level")
    stop = known(F.when(is_long, F.col("low") <= sl).otherwise(F.col("high") >= sl))
    target = known(F.when(is_long, F.col("high") >= tp).otherwise(F.col("low") <= tp))
    # on the entry bar the open came before the entry, so levels fill at the level
    opened = F.when(F.col("bar_no") > F.col("entry_no"), F.col("open"))
    code = F.when(stop, 0).when(target, 1)
    price = F.when(stop, F.when(is_long, F.least(opened, sl)).otherwise(F.greatest(opened, sl))).when(
        target, F.when(is_long, F.greatest(opened, tp)).otherwise(F.least(opened, tp))
    )
    if "band_long" in extra:
        band = F.when(is_long, F.col("band_long")).otherwise(F.col("band_short"))
        touched = known(F.when(is_long, F.col("high") >= band).otherwise(F.col("low") <= band))
        code = code.when(touched, 2)
        price = price.when(touched, band_fill(band))
    if "opposite" in extra:
        turned = known(F.col("opposite") == -F.col("dir"))
        code = code.when(turned, 3)
        price = price.when(turned, F.col("open"))
    if "eod" in extra:
        code = code.when(known(F.col("eod")), 4)
        price = price.when(known(F.col("eod")), F.col("close"))
    timed = F.col("bar_no") == F.col("entry_no") + max_bars
    walk = walk.withColumn("_code", code.when(timed, 5)).withColumn("_price", price.when(timed, F.col("close")))
    return _first_exit(walk, entries.columns)


def _first_exit(walk: DataFrame, entry_cols: Sequence[str]) -> DataFrame:
    """Earliest touch per entry; entries without one stay open. ``_code`` indexes ``REASONS``.

    The entry's own columns are the grouping key, so nothing is joined back.
    """
    at = F.when(F.col("_code").isNotNull(), F.col("bar_no"))
    return (
        walk.groupBy(*entry_cols)
        .agg(
            F.min(at).alias("exit_no"),
            F.min_by("bar_ts", at).alias("exit_ts"),
            F.min_by("_price", at).alias("exit_price"),
            F.min_by("_code", at).alias("_code"),
        )
        .withColumn("exit_reason", F.coalesce(*[F.when(F.col("_code") == i, x) for i, x in enumerate(REASONS)]))
        .withColumn("ret", F.col("dir") * (div(F.col("exit_price"), F.col("price")) - 1))
        .drop("_code")
    )


def band_fill(band: Column) -> Column:
    """A band target fills at the band, clipped into the bar."""
    return F.least(F.greatest(band, F.col("low")), F.col("high"))


def trailing_outcomes(
    entries: DataFrame,
    bars: DataFrame,
    distance: Column | float,
    max_bars: int,
    ids: Sequence[str] = ("symbol", "entry_no", "dir"),
) -> DataFrame:
    """Stop that follows the best price of the bars before the current one; at most ``max_bars`` long."""
    path = bars.select("symbol", "bar_no", F.col("ts").alias("bar_ts"), "open", "high", "low", "close")
    d = F.lit(distance) if isinstance(distance, (int, float)) else distance
    walk = span_join(
        entries.withColumn("_d", d),
        path,
        ["symbol"],
        F.col("entry_no") + 1,
        F.col("entry_no") + max_bars,
        "bar_no",
        max(SPAN, max_bars),
        "left",
    )
    before = Window.partitionBy(*ids).orderBy("bar_no").rowsBetween(Window.unboundedPreceding, -1)
    is_long = F.col("dir") == 1
    peak = F.when(is_long, F.greatest(F.col("price"), F.max("high").over(before))).otherwise(
        F.least(F.col("price"), F.min("low").over(before))
    )
    out = walk.withColumn("_peak", peak).withColumn("_level", F.col("_peak") * (1 - F.col("dir") * F.col("_d")))
    hit = F.when(is_long, F.col("low") <= F.col("_level")).otherwise(F.col("high") >= F.col("_level"))
    fill = F.when(is_long, F.least("open", "_level")).otherwise(F.greatest("open", "_level"))
    timed = F.col("bar_no") == F.col("entry_no") + max_bars
    out = out.withColumn("_code", F.when(known(hit), 6).when(timed, 5)).withColumn(
        "_price", F.when(known(hit), fill).otherwise(F.col("close"))
    )
    return _first_exit(out, entries.columns)


def time_exits(entries: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """Exit at the close ``n`` bars after entry."""
    target = bars.select(
        "symbol",
        (F.col("bar_no") - n).alias("entry_no"),
        F.col("ts").alias("exit_ts"),
        F.col("close").alias("exit_price"),
    )
    return entries.join(target, ["symbol", "entry_no"], "left").withColumn(
        "ret", F.col("dir") * (div(F.col("exit_price"), F.col("price")) - 1)
    )


def excursions(trades: DataFrame, bars: DataFrame, ids: Sequence[str], width: int = SPAN) -> DataFrame:
    """Best move in the trade's favour between entry and exit bars, as a fraction of the entry price."""
    path = bars.select("symbol", "bar_no", "high", "low")
    closed = trades.where(F.col("exit_no").isNotNull())
    walk = span_join(closed, path, ["symbol"], F.col("entry_no"), F.col("exit_no"), "bar_no", width)
    best = walk.groupBy(*ids, "price").agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    mfe = F.when(F.col("dir") == 1, div(F.col("_h"), F.col("price")) - 1).otherwise(
        1 - div(F.col("_l"), F.col("price"))
    )
    return best.withColumn("mfe", mfe).drop("_h", "_l")


# ------------------------------------------------------------------ single position


def non_overlapping(
    trades: DataFrame,
    keys: Sequence[str],
    entry: str = "entry_ts",
    exit_: str = "exit_ts",
    tie: Sequence[str] = (),
    bucket_seconds: int = 7 * 86400,
    chunk: int = 4096,
    whole: int | None = None,
) -> DataFrame:
    """Take a trade only when the previous taken one has ended, per key, in order of entry.

    Keys of at most ``whole`` trades (64 chunks unless given) are dealt to the tasks and walked through in order in
    one pass. For longer keys the chain "first trade at or after my exit" is followed in chunks of ``chunk`` trades in parallel:
    each chunk maps the trades where a chain can enter it to the trade in a later chunk where it
    leaves. From the first trade on, doubling those jumps by joins on (key, number) finds the true entry
    points in about log2(chunks) rounds, however many trades overlap, and a second pass over the chunks
    marks the taken trades; there, no task holds more of a key than a chunk. Trades may share an entry
    time; ``tie`` must order them fully, and an exit frees the slot for an entry at the same instant.
    """
    keys = list(keys)
    order = [entry, *tie]
    most = 64 * chunk if whole is None else whole
    # at most one row per ``most`` trades of the table
    long = stage(trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys), "long-keys")
    if long.isEmpty():
        return _walked(trades, keys, order, entry, exit_)
    held = stage(trades, "trades")
    short = _walked(held.join(long, keys, "left_anti"), keys, order, entry, exit_)
    return short.unionByName(_chained(held.join(long, keys, "left_semi"), keys, order, entry, exit_, bucket_seconds, chunk))


def _walked(trades: DataFrame, keys: list[str], order: list[str], entry: str, exit_: str) -> DataFrame:
    """Single-position selection of keys that each fit a task: a walk in order that remembers when the slot gets free.

    As in chunks, a key with a trade of unknown entry has no known first trade and gives none.
    """
    unknown, never = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, free = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k) for k in keys]
            fresh = np.zeros(b.num_rows, bool)
            fresh[0] = [c[0].as_py() for c in cols] != key
            for c in cols:
                fresh[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            key = [c[-1].as_py() for c in cols]
            # a trade without an end keeps the slot
            starts, ends = (pc.fill_null(b.column(c), v).to_numpy().tolist() for c, v in (("_s", unknown), ("_e", never)))
            on = []
            for i, (new, start, end) in enumerate(zip(fresh.tolist(), starts, ends, strict=True)):
                if new:
                    free = never if start == unknown else start
                if start >= free:
                    on.append(i)
                    free = end
            yield b.take(pa.array(on, pa.int64())).select(names)

    names = trades.columns
    for k in keys:
        trades = trades.where(F.col(k).isNotNull())
    # unknown entries come first
    dealt = trades.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.withColumns({"_s": F.unix_micros(entry), "_e": F.unix_micros(exit_)}).mapInArrow(walk, trades.schema)


def _chained(trades: DataFrame, keys: list[str], order: list[str], entry: str, exit_: str, bucket_seconds: int, chunk: int) -> DataFrame:
    bucket = F.floor(F.unix_micros(entry) / F.lit(bucket_seconds * 1_000_000))
    numbered = stage(number_rows(trades, keys, order, bucket, "_no"), "numbered")
    firsts = numbered.groupBy(*keys, entry).agg(F.min("_no").alias("_next"))
    slim = numbered.select(*keys, "_no", exit_)
    linked = asof(slim, firsts, keys, exit_, entry, {"_next": "_next"}, direction="forward", width=bucket_seconds)
    # a trade that ends the instant it starts still hands over to a later one
    linked = linked.withColumn(
        "_next", F.when(F.col("_next").isNotNull(), F.greatest(F.col("_next"), F.col("_no") + 1))
    ).select(*keys, "_no", "_next", F.floor(F.col("_no") / F.lit(chunk)).alias("_b"))
    linked = stage(linked, "linked")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trades.select(*keys).schema) + ", _no bigint"

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, [*keys, "_b"]):
            nxt, target, inside = _links(b, [*keys, "_b"])
            out = nxt.copy()
            for i in np.flatnonzero(inside)[::-1]:
                out[i] = out[target[i]]
            yield b[[*keys, "_no"]].assign(_out=out)

    exits = stage(_grouped(linked, [*keys, "_b"], "_no").mapInPandas(leave, f"{schema}, _out double"), "leaving")
    # only trades some earlier chunk can lead to, plus the very first, matter between chunks
    targets = (
        exits.where(F.col("_out").isNotNull() & ~F.isnan("_out"))
        .select(*keys, F.col("_out").cast("long").alias("_no"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    hops = exits.join(targets, [*keys, "_no"], "left").where(F.col("_hit") | (F.col("_no") == 0)).drop("_hit")

    entered = _along(stage(hops, "hops"), keys, linked.agg(F.max("_b")).first()[0] or 0)
    marked = linked.join(entered.withColumn("_in", F.lit(True)), [*keys, "_no"], "left")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, [*keys, "_b"]):
            _, target, inside = _links(b, [*keys, "_b"])
            on = b["_in"].notna().to_numpy().copy()
            for i in np.flatnonzero(inside):
                if on[i]:
                    on[target[i]] = True
            yield b.loc[on, [*keys, "_no"]]

    taken = _grouped(marked, [*keys, "_b"], "_no").mapInPandas(take, schema)
    return numbered.join(taken, [*keys, "_no"], "left_semi").drop("_no")


def _along(hops: DataFrame, keys: Sequence[str], last_chunk: int) -> DataFrame:
    """(keys, _no) of the nodes that the chain from number 0 visits; every hop leads to a later chunk.

    After k rounds the first 2^k nodes are known and a jump spans 2^k hops, so the nodes that a round adds are new.
    """
    jump = hops.where(F.col("_out").isNotNull() & ~F.isnan("_out")).select(*keys, "_no", F.col("_out").cast("long").alias("_out"))
    visited = hops.where(F.col("_no") == 0).select(*keys, "_no")
    for left in range(int(last_chunk).bit_length() - 1, -1, -1):
        more = visited.join(jump, [*keys, "_no"]).select(*keys, F.col("_out").alias("_no"))
        visited = stage(visited.unionByName(more), "visited")
        if left:
            then = jump.select(*keys, F.col("_no").alias("_out"), F.col("_out").alias("_to"))
            jump = stage(jump.join(then, [*keys, "_out"]).select(*keys, "_no", F.col("_to").alias("_out")), "jumps")
    return visited


def _grouped(df: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Rows of a group next to each other in one partition, in order."""
    return df.repartition(*group).sortWithinPartitions(*group, order)


def _starts(b: pd.DataFrame, group: Sequence[str]) -> np.ndarray:
    """Position of the first row of each row's group; groups are contiguous."""
    fresh = np.ones(len(b), bool)
    fresh[1:] = (b[list(group)].to_numpy()[1:] != b[list(group)].to_numpy()[:-1]).any(axis=1)
    return np.maximum.accumulate(np.where(fresh, np.arange(len(b)), 0))


def _links(b: pd.DataFrame, group: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successor number, its row position, and whether it lies in the same chunk."""
    no, nxt, start = b["_no"].to_numpy(), b["_next"].to_numpy(dtype=float), _starts(b, group)
    last = np.r_[np.flatnonzero(np.diff(start)), len(b) - 1]
    end = no[last[np.searchsorted(last, np.arange(len(b)))]]
    inside = nxt <= end
    target = np.where(inside, start + np.nan_to_num(nxt) - no[start], 0).astype(int)
    return nxt, target, inside


def whole_groups(batches: Iterator[pd.DataFrame], group: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that no group is split between two of them."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if b.empty:
            continue
        cut = int(_starts(b, group)[-1])
        held = b.iloc[cut:]
        if cut:
            yield b.iloc[:cut].reset_index(drop=True)
    if held is not None and len(held):
        yield held.reset_index(drop=True)


# ------------------------------------------------------------------ costs and P&L


def net_return(gross: Column, fee: Column, slippage: float = SLIPPAGE_BACKTEST) -> Column:
    """Return after a fee and slippage on both sides."""
    return gross - 2 * (fee + F.lit(slippage))


def restate_fee_pct(fee_now: Column, fee_run: Column) -> Column:
    return 200 * (fee_now - fee_run)


def minimum_fee_shortfall_pct(minimum_usd: float, stake: Column, fee_pct: Column) -> Column:
    """Extra cost in percent when a per-order minimum exceeds the percentage fee."""
    return 2 * F.greatest(F.lit(0.0), div(F.lit(minimum_usd), stake) * 100 - fee_pct)


def closed_pnl(side: Column, qty: Column, entry: Column, exit_: Column, fee: Column) -> Column:
    """Signed price move times quantity, less the fee on both fills."""
    sign = F.when(side == "long", 1.0).otherwise(-1.0)
    return (exit_ - entry) * qty * sign - (entry + exit_) * qty * fee
