"""Components of a candidate-bucket join without writing out a bucket's pairs.

A bucket (an equal slot value) makes its members candidates for each other. Instead of all pairs, every member
is paired with one representative of its bucket: inside an input task with the first member that the task saw
(``local_stars``), across tasks with the smallest of those (``star_pairs``). A bucket whose tree of pairs lies
in one component after verification needs nothing more. Only of the others all members are gathered again
(``link``), and only pairs from different components are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import mix, stage, thrifty, tidy
from tapeloom.llm.components import components
from tapeloom.llm.grouped import dealt, gathered, runs

#: bits of a slot; unlike slots that agree in them are one bucket, whose members are verified as all others
SLOT_BITS = 48
SLOT_MASK = (1 << SLOT_BITS) - 1
#: rows of :class:`LocalStars`: a pair, or the members that a task met first, packed for one part of the slots
STAR = "part int, id long, rep long, slots array<long>, packed binary"
STAR_ARROW = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("rep", pa.int64()), ("slots", pa.list_(pa.int64())), ("packed", pa.binary())])
PAIR_ARROW = pa.schema([("id", pa.int64()), ("rep", pa.int64()), ("slots", pa.list_(pa.int64()))])
#: no slot is negative
NO_SLOT = -1
#: slots one task remembers; beyond it the memory starts anew and a bucket gets one more local representative
REMEMBERED = 300_000
#: (slot, member) entries that a task holds before it writes them out, and those of one part, about
HELD, PART_ENTRIES = 200_000, 1 << 19


def parts_for(entries: int) -> int:
    return max(8, -(-entries // PART_ENTRIES))


def pack(slots: np.ndarray, ids: np.ndarray) -> bytes:
    """Entries of equal neighbouring ids together: ids as differences, counts, then six bytes per slot."""
    new = np.r_[True, ids[1:] != ids[:-1]]
    starts = np.flatnonzero(new)
    counts = np.diff(np.r_[starts, len(ids)]).astype("<i4")
    steps = np.diff(np.r_[np.int64(0), ids[starts]]).astype("<i8")
    body = np.ascontiguousarray(slots.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : SLOT_BITS // 8])
    return len(starts).to_bytes(4, "little") + steps.tobytes() + counts.tobytes() + body.tobytes()


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:4], "little")
    steps, counts = np.frombuffer(packed, "<i8", n, 4), np.frombuffer(packed, "<i4", n, 4 + 8 * n)
    body = np.frombuffer(packed, np.uint8, offset=4 + 12 * n).reshape(-1, SLOT_BITS // 8)
    wide = np.zeros((len(body), 8), np.uint8)
    wide[:, : SLOT_BITS // 8] = body
    return wide.view("<i8").ravel(), np.repeat(np.cumsum(steps), counts)


class LocalStars:
    """Pairs the members of a bucket with the first one that this task has seen."""

    def __init__(self, parts: int):
        self.parts = parts
        self.first: dict[int, int] = {}
        self.slots: list[int] = []
        self.nodes: list[int] = []
        self.times: list[int] = []
        self.pairs: list[tuple] = []

    def sure(self, node: int, rep: int) -> None:
        """A link that needs no verification."""
        self.pairs.append((node, rep, []))

    def add(self, node: int, slots: list[int]) -> None:
        if len(self.first) > REMEMBERED:
            self.first = {}
        reps = list(map(self.first.get, slots))
        missing = reps.count(None)
        if missing < len(slots):
            known: dict[int, list[int]] = {}
            for slot, rep in zip(slots, reps, strict=True):
                if rep is not None and rep != node:
                    known.setdefault(rep, []).append(slot)
            for rep, own in known.items():
                self.pairs.append((node, rep, own))
            slots = [slot for slot, rep in zip(slots, reps, strict=True) if rep is None]
        if slots:
            self.first.update(zip(slots, repeat(node)))
            self.slots += slots
            self.nodes.append(node)
            self.times.append(len(slots))

    @property
    def full(self) -> bool:
        return len(self.slots) + len(self.pairs) > HELD

    def batch(self) -> pa.RecordBatch:
        """What has been gathered; pairs are dealt by their nodes."""
        slots = np.array(self.slots, np.int64)
        nodes = np.repeat(np.array(self.nodes, np.int64), self.times)
        part = slots % self.parts
        order = np.argsort(part, kind="stable")
        slots, nodes, part = slots[order], nodes[order], part[order]
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
        packed = [pack(slots[a:b], nodes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        n, (ids, reps, own) = len(packed), zip(*self.pairs, strict=True) if self.pairs else ((), (), ())
        at = (np.array(ids, np.int64) ^ np.array(reps, np.int64)) % self.parts
        cols = [
            pa.array(np.r_[part[edges[:-1]] if n else part[:0], at].astype(np.int32)),
            pa.array([None] * n + list(ids), pa.int64()),
            pa.array([None] * n + list(reps), pa.int64()),
            pa.array([None] * n + list(own), pa.list_(pa.int64())),
            pa.array(packed + [None] * len(ids), pa.binary()),
        ]
        self.slots, self.nodes, self.times, self.pairs = [], [], [], []
        return pa.RecordBatch.from_arrays(cols, schema=STAR_ARROW)


class SlotFilter:
    """A bitmap of fixed size over slots: False for most slots that are not in it, True for all that are."""

    BITS = 1 << 25

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, slots: DataFrame) -> "SlotFilter":
        """Gathers at most ``BITS / 64`` words, however many slots there are."""
        at = F.pmod("slot", F.lit(cls.BITS))
        word, bit = F.floor(at / 64).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(pmod(slot, {cls.BITS}), 64) as int))")
        rows = slots.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        words = np.zeros(cls.BITS // 64, np.int64)
        for batch in rows.toArrow().to_batches():
            words[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        return cls(words.view(np.uint64))

    def has(self, slots: np.ndarray) -> np.ndarray:
        at = slots % self.BITS
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def keeps(self, column):
        """Condition on a long column; only its values go to Python."""

        @F.pandas_udf("boolean")
        def has(values):
            import pandas as pd

            return pd.Series(self.has(values.fillna(0).to_numpy(np.int64)))

        return has(column)


def _centred(parts: int):
    """(member, representative, slot) entries of whole parts: pairs of the tasks, and each packed member of a bucket
    with the bucket's smallest. They leave as lists, one per part of the pairs, so a pair that shares slots of many
    parts is no row in each of them."""

    def run(batches):
        held, n = [], 0
        for table in runs(batches, "part"):
            local = table.filter(pc.is_null(table.column("packed")))
            if local.num_rows:
                held.append(_local_entries(local))
                n += len(held[-1][0])
            found = [unpack(p) for p in table.column("packed").drop_null().to_pylist()]
            if found:
                slots, ids = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((ids, slots))
                slots, ids = slots[order], ids[order]
                start = np.maximum.accumulate(np.where(np.r_[True, slots[1:] != slots[:-1]], np.arange(len(slots)), 0))
                low = ids[start]
                at = np.flatnonzero(low < ids)
                held.append((ids[at], low[at], slots[at]))
                n += len(at)
            if n > HELD:
                yield _dealt_entries(held, parts)
                held, n = [], 0
        yield _dealt_entries(held, parts)

    return thrifty(run)


def _local_entries(local: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the pairs that tasks have found; a certain one has ``NO_SLOT``."""
    ids, reps = (local.column(c).to_numpy() for c in ("id", "rep"))
    own = local.column("slots").to_pylist()
    times = np.array([max(1, len(s)) for s in own], np.int64)
    return np.repeat(ids, times), np.repeat(reps, times), np.array([x for s in own for x in (s or (NO_SLOT,))], np.int64)


def _dealt_entries(held: list[tuple], parts: int) -> pa.RecordBatch:
    ids, reps, slots = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
    part = (mix((ids ^ reps).view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((reps, ids, part))
    part = part[order]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
    lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(c[order])) for c in (ids, reps, slots)]
    return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), *lists], names=["part", "ids", "reps", "slots"])


def _paired(batches):
    """One row per pair of a part, with all its slots."""

    def pairs(table: pa.Table) -> pa.Table:
        ids, reps, slots = (pc.list_flatten(table.column(c).combine_chunks()).to_numpy() for c in ("ids", "reps", "slots"))
        order = np.lexsort((slots, reps, ids))
        ids, reps, slots = ids[order], reps[order], slots[order]
        new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (reps[1:] != reps[:-1])])
        real = slots != NO_SLOT
        edges = np.r_[0, np.cumsum(real)][np.r_[new, len(ids)]]
        shared = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(slots[real]))
        return pa.Table.from_arrays([pa.array(ids[new]), pa.array(reps[new]), shared], schema=PAIR_ARROW)

    return gathered((pairs(t) for t in runs(batches, "part")), 20_000, PAIR_ARROW)


def star_pairs(stars: DataFrame, parts: int) -> DataFrame:
    """(id, rep, slots) for each candidate pair of the trees; ``stars`` has the columns of ``STAR``.

    A part holds about ``PART_ENTRIES`` entries: per bucket one member of each input task at most, not all members.
    """
    found = dealt(stars, "part").mapInArrow(_centred(parts), "part int, ids array<long>, reps array<long>, slots array<long>")
    return dealt(found, "part").mapInArrow(_paired, "id long, rep long, slots array<long>")


def link(
    stars: DataFrame,
    parts: int,
    members: Callable[[SlotFilter], DataFrame],
    facts: DataFrame,
    may: str,
    verify: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``node``, ``component`` for all nodes with a verified link; exact with respect to the candidates.

    stars    rows of ``LocalStars`` over all nodes; a pair without slots is a link already certain
    parts    number of parts of ``stars``
    members  (slot, id) rows again, without local stars; slots that the filter hasn't may be left out
    facts    id and columns of a node that ``may`` refers to as l.column and r.column
    may      SQL condition that every link meets
    verify   (id, rep) pairs -> those that are links
    """
    spark = stars.sparkSession
    pairs = stage(star_pairs(stars, parts), "pairs")
    tidy(spark)
    left, right = (facts.select(*(F.col(c).alias(f"{side}_{c}") for c in facts.columns)) for side in "lr")
    may = re.sub(r"\b([lr])\.", r"\1_", may)
    tried = pairs.where("size(slots) > 0").select("id", "rep", F.size("slots").alias("shared"))
    alike = tried.join(left, F.col("id") == F.col("l_id")).join(right, F.col("rep") == F.col("r_id"))
    alike = stage(alike.where(may).groupBy("id", "rep").agg(F.max("shared").alias("shared")), "pairs")
    # the pair with most slots in common first; most others then lie in one component already
    best = alike.groupBy("id").agg(F.max_by("rep", "shared").alias("rep"))
    links = verify(best).unionByName(pairs.where("size(slots) = 0").select("id", "rep"))
    found = components(links.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    tidy(spark)

    def of(df: DataFrame, key: str, name: str) -> DataFrame:
        comp = found.select(F.col("node").alias("n_" + name), F.col("component").alias("c_" + name))
        joined = df.join(comp, F.col(key) == F.col("n_" + name), "left")
        return joined.withColumn(name, F.coalesce("c_" + name, key)).drop("n_" + name, "c_" + name)

    rest = of(of(alike, "id", "ci"), "rep", "cr").where("ci <> cr").select("id", "rep")
    found = _joined(found, stage(verify(rest.join(best, ["id", "rep"], "left_anti")), "links"))
    torn = of(of(pairs, "id", "ci"), "rep", "cr").where("ci <> cr").select(F.explode("slots").alias("slot"))
    torn = stage(torn.distinct(), "torn")
    if torn.isEmpty():
        return found
    held = of(members(SlotFilter.of(torn)).join(torn, "slot", "left_semi"), "id", "comp").join(left, F.col("id") == F.col("l_id"))
    held = stage(held.drop("id"), "members")
    other = held.select(*(F.col(c).alias("r_" + c.removeprefix("l_")) for c in held.columns))
    near = held.join(other, F.expr(f"slot = r_slot and comp < r_comp and {may}"))
    more = stage(near.select(F.col("l_id").alias("id"), F.col("r_id").alias("rep")).distinct(), "pairs")
    return _joined(found, stage(verify(more), "links"))


def _joined(found: DataFrame, late: DataFrame) -> DataFrame:
    """Components with further links (id, rep) added."""
    if late.isEmpty():
        return found
    before = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(before.unionByName(late.select(F.col("id").alias("a"), F.col("rep").alias("b"))))
