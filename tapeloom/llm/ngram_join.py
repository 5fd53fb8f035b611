"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct k-word shingles. Each shingle flips one bit of a long bit sketch, so two
sketches differ in at most as many bits as their sets differ in elements. Sets that may link differ in at most
D elements, where D follows from their sizes; a sketch cut into D+1 segments has a segment that agrees. Sizes
are split into bands so that linked sets lie in one band or two neighbours, and each band has its own D. The
segments of a band are the buckets of the candidate join (see ``linking``); pairs of a bucket that still
matter are compared by the Hamming distance of short sketches, and what is left is verified on the shingles.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import GOLDEN, bounded, fresh, mix, prepare, shingles, stage, thrifty
from tapeloom.llm.linking import SLOT_MASK, STAR, LocalStars, SlotFilter, link, parts_for

#: bits of a segment: few elements fall into one, so with few bits unlike sets would often agree in it by chance
SEGMENT_BITS = 28
#: bits of a segment's number and its bits; above them stands the row of the batch
PLACE_BITS = 52
SKETCH_WORDS = 16


class Bands:
    """Size bands of a threshold of ``percent``: sizes of a linked pair are at most one band apart."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must lie between 50 and 100")
        self.percent, self.lows = percent, [1]

    def of(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(100 * self.lows[-1] // self.percent + 1)
        return bisect.bisect_right(self.lows, size) - 1

    def top(self, band: int) -> int:
        while len(self.lows) <= band + 1:
            self.lows.append(100 * self.lows[-1] // self.percent + 1)
        return self.lows[band + 1] - 1

    def differing(self, both: int) -> int:
        """The most elements in which two linked sets differ whose sizes add up to ``both``."""
        return (100 - self.percent) * both // (100 + self.percent)

    def plan(self, size: int, band: int) -> tuple[int, int, int]:
        """(segments of the band, leading ones that a set of this size needs, matches beyond the first)."""
        top = self.top(band)
        most = self.differing(2 * top)
        # a set at the lower end of the next band leaves about one segment in thirteen empty; more than that are left out
        slack = most // 8 + 1 if most else 0
        own = self.differing(size + min(100 * size // self.percent, top))
        return most + 1 + slack, min(own, most) + 1 + slack, slack


def segments(hashes: np.ndarray, offsets: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket keys, set) of each set's leading sketch segments, in its own band and in the next one.

    A linked pair agrees in at least ``slack + 1`` of the segments that both need, so empty segments
    can be left out by every set that has no more than ``slack`` of them.
    """
    sizes, out = np.diff(offsets), []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    home = [bands.of(n) if n else 0 for n in sizes.tolist()]
    for step in (0, 1):
        plans = np.array([bands.plan(n, b + step) if n else (1, 0, 0) for n, b in zip(sizes.tolist(), home, strict=True)], np.int64).reshape(-1, 3)
        parts, need, slack = plans.T
        band = np.array(home, np.uint64) + np.uint64(step)
        h = mix(hashes ^ ((band + np.uint64(1)) * np.uint64(GOLDEN))[owner])
        part = ((h >> np.uint64(32)) * parts.astype(np.uint64)[owner]) >> np.uint64(32)
        inside = part < need.astype(np.uint64)[owner]
        bit = h & np.uint64((1 << SEGMENT_BITS) - 1)
        bits = (owner.astype(np.uint64) << np.uint64(PLACE_BITS)) | (part << np.uint64(SEGMENT_BITS)) | bit
        bits = np.sort(bits[inside])
        # a bit that was flipped an even number of times is off
        edge = np.flatnonzero(np.r_[True, bits[1:] != bits[:-1], True]) if len(bits) else np.zeros(1, int)
        bits = bits[edge[:-1][np.diff(edge) % 2 == 1]] if len(bits) else bits
        place = bits >> np.uint64(SEGMENT_BITS)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(bits) else np.zeros(0, int)
        low = np.uint64((1 << PLACE_BITS) - 1)
        content = np.add.reduceat(mix((bits & low) * np.uint64(GOLDEN) + np.uint64(1)), starts) if len(bits) else np.zeros(0, np.uint64)
        place = place[starts]
        doc, seg = (place >> np.uint64(PLACE_BITS - SEGMENT_BITS)).astype(np.int64), place & np.uint64((1 << (PLACE_BITS - SEGMENT_BITS)) - 1)
        empty = need - np.bincount(doc, minlength=len(sizes))
        for d in np.flatnonzero(empty > slack).tolist():
            gone = np.setdiff1d(np.arange(need[d], dtype=np.uint64), seg[doc == d])
            content, doc, seg = np.r_[content, np.zeros(len(gone), np.uint64)], np.r_[doc, np.full(len(gone), d)], np.r_[seg, gone]
        keys = mix(content + mix(seg * np.uint64(GOLDEN) + band[doc] * np.uint64(7919) + np.uint64(13)))
        out.append(((keys & np.uint64(SLOT_MASK)).view(np.int64), doc))
    return out


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Short parity sketches, one row of words per set: Hamming distances never exceed symmetric differences."""
    bits, n = 64 * SKETCH_WORDS, len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    at = owner * bits + (mix(hashes) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) % 2).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, SKETCH_WORDS)


def wide_sketches(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray | None]:
    """Parity sketches with a bit or two per element, for sets that crowd the short ones; its halves folded together
    are the sketch of half the width."""
    out: list[np.ndarray | None] = [None] * (len(offsets) - 1)
    for i in np.flatnonzero(np.diff(offsets) > 64 * SKETCH_WORDS).tolist():
        own = hashes[offsets[i] : offsets[i + 1]]
        bits = 1 << (len(own) - 1).bit_length()
        at = (mix(own) & np.uint64(bits - 1)).astype(np.int64)
        out[i] = np.packbits((np.bincount(at, minlength=bits) % 2).astype(np.uint8)).view(np.int64)
    return out


def _sets(batch: pa.RecordBatch, k: int) -> tuple[list, np.ndarray, np.ndarray]:
    return batch.column(0).to_pylist(), *shingles(batch.column(1).cast(pa.binary()).to_pylist(), k)


def _stars(k: int, percent: int, parts: int):
    def run(batches):
        bands, stars, seen = Bands(percent), LocalStars(parts), {}
        for batch in bounded(batches):
            nodes, hashes, offsets = _sets(batch, k)
            marks = mix(hashes)
            sums = [(np.add.reduceat(v, offsets[:-1][np.diff(offsets) > 0]) if len(v) else v).tolist() for v in (hashes, marks)]
            same = iter(zip(*sums, strict=True))
            split = []
            for keys, doc in segments(hashes, offsets, bands):
                order = np.argsort(doc, kind="stable")
                split.append((keys[order].tolist(), np.searchsorted(doc[order], np.arange(len(nodes) + 1)).tolist()))
            for i, (node, n) in enumerate(zip(nodes, np.diff(offsets).tolist(), strict=True)):
                if not n:
                    continue
                key = (n, *next(same))
                if node is None:
                    continue
                if len(seen) > 200_000:
                    seen = {}
                first = seen.setdefault(key, node)
                if first != node:
                    stars.sure(node, first)
                else:
                    stars.add(node, [s for keys, cut in split for s in keys[cut[i] : cut[i + 1]]])
                if stars.full:
                    yield stars.batch()
        yield stars.batch()

    return thrifty(run)


def _members(k: int, percent: int, wanted: SlotFilter):
    def run(batches):
        bands = Bands(percent)
        for batch in bounded(batches):
            nodes, hashes, offsets = _sets(batch, k)
            nodes = np.array(nodes, np.int64)
            for keys, doc in segments(hashes, offsets, bands):
                has = wanted.has(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys[has]), pa.array(nodes[doc[has]])], names=["slot", "id"])

    return thrifty(run)


def _facts(k: int):
    names = ["id", "n", *(f"s{i}" for i in range(SKETCH_WORDS)), "wide"]

    def run(batches):
        for batch in bounded(batches):
            _, hashes, offsets = _sets(batch, k)
            sketch = sketches(hashes, offsets)
            cols = [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_WORDS)]
            cols.append(pa.array(wide_sketches(hashes, offsets), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), *cols], names=names)

    return thrifty(run)


def _verify(k: int, percent: int):
    def run(batches):
        for batch in bounded(batches):
            left, a = shingles(batch.column(2).cast(pa.binary()).to_pylist(), k)
            right, b = shingles(batch.column(3).cast(pa.binary()).to_pylist(), k)
            keep = []
            for i in range(batch.num_rows):
                x, y = left[a[i] : a[i + 1]], right[b[i] : b[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["id", "rep"]).filter(pa.array(keep, pa.bool_()))

    return thrifty(run)


def closer(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(id, rep) pairs without those of large sets whose wide sketches differ in more bits than linked sets do in elements.

    Short sketches of thousands of elements are half full whatever the sets hold, so they tell no large sets apart.
    """
    left, right = (known.select(F.col("id").alias(s), F.col("n").alias(s + "_n"), F.col("wide").alias(s + "_wide")) for s in "lr")
    joined = pairs.join(left, F.col("id") == F.col("l")).join(right, F.col("rep") == F.col("r"))
    # sets that may link are at most twice as large as each other, and so are their sketches
    folded = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (a, b) -> a ^ b), {0})"
    both = [folded.format("l_wide", "r_wide"), folded.format("r_wide", "l_wide")]
    apart = f"aggregate(zip_with({both[0]}, {both[1]}, (a, b) -> bit_count(a ^ b)), 0, (x, y) -> x + y)"
    near = f"(l_wide is null or r_wide is null or {100 + percent} * {apart} <= {100 - percent} * (l_n + r_n))"
    return joined.where(f"100 * least(l_n, r_n) >= {percent} * greatest(l_n, r_n) and {near}").select("id", "rep").distinct()


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of (id, rep) pairs those whose Jaccard similarity reaches the threshold. ``docs``: columns id, text."""
    pairs = stage(pairs, "pairs")
    both = pairs.select(F.col("id").alias("slot")).unionByName(pairs.select(F.col("rep").alias("slot")))
    # texts of no pair stay where they are; the join drops what the filter lets through
    texts = stage(docs.where(F.col("id").isNotNull() & SlotFilter.of(both).keeps(F.col("id"))), "texts")
    left, right = (texts.select(F.col("id").alias(n), F.col("text").alias(n + "t")) for n in "lr")
    joined = pairs.join(left, F.col("id") == F.col("l")).join(right, F.col("rep") == F.col("r"))
    return joined.select("id", "rep", "lt", "rt").mapInArrow(_verify(k, percent), "id long, rep long").distinct()


def facts(docs: DataFrame, k: int) -> DataFrame:
    """id, n (set size), a short sketch and that of large sets (``wide``) of every document; ``docs``: columns id, text."""
    shape = "id long, n long, " + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS)) + ", wide array<long>"
    return stage(docs.mapInArrow(_facts(k), shape), "facts")


def _groups(slim: DataFrame, known: DataFrame, k: int, percent: int) -> DataFrame:
    apart = " + ".join(f"bit_count(l.s{i} ^ r.s{i})" for i in range(SKETCH_WORDS))
    may = f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) and {100 + percent} * ({apart}) <= {100 - percent} * (l.n + r.n)"
    # a set has at most half as many segments as elements
    entries = (known.agg(F.sum("n")).first()[0] or 0) // 2
    return link(
        slim.mapInArrow(_stars(k, percent, parts_for(entries)), STAR),
        parts_for(entries),
        lambda wanted: slim.where("id is not null").mapInArrow(_members(k, percent, wanted), "slot long, id long"),
        known.drop("wide"),
        may,
        lambda pairs: verified(slim, closer(pairs, known, percent), k, percent),
    )


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node``, ``component`` of every document that links with another one (smallest id of its group).

    Two documents link when ``100 * intersection >= percent * union`` of their shingle sets. Texts without a
    word, null texts and rows with a null id link with nothing. Rows that share an id are one node with
    several texts; a link of any of them counts. An empty table has no groups.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return _groups(slim, facts(slim, k), k, percent)


def label(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (see :func:`groups`); a null id keeps a null class."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = facts(slim, k)
    found = _groups(slim, known, k, percent)
    joined = known.join(found, F.col("id") == F.col("node"), "left")
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its group or that have no group."""
    node, comp = fresh(docs.columns, "_node", "_component")
    found = groups(docs, k, percent, id_col, text_col).where("node <> component").select(F.col("node").alias(node), F.col("component").alias(comp))
    return docs.join(found, F.col(f"`{id_col}`") == F.col(node), "left_anti")
