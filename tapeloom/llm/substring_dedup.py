"""Repeated passages by paragraph MinHash banding.

Paragraphs (lines) of enough words are the units. Equal word sequences collapse first, so a line that a third
of all documents share is one unit. Each unit gets a MinHash signature over its word shingles; signatures are cut
into bands whose number and width are tuned for the wanted recall at the threshold. Units that agree in a band
are linked after verification by exact Jaccard similarity (or by word edit distance), without writing out a
band's pairs (see ``linking``). All occurrences in a component but the first are repeats.

``passages`` adds what doesn't depend on line breaks. Neighbouring lines too short to be units are joined to a
block, a unit like a line. And every run of ``RUN`` words that occurs twice is found, wherever it begins: the
least hash of the ``GRAM``-word pieces inside a run depends on nothing but its words, so two equal runs share it.
A first pass counts those least pieces, a second one writes out only runs whose least piece occurs twice.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import GOLDEN, MIX1, MIX2, SPACE, bounded, fresh, mix, prepare, ranged, release, rolled, shingles, stage, staged, tidy, word_hashes
from tapeloom.llm.linking import SLOT_MASK, STAR, LocalStars, SlotFilter, link, parts_for
from tapeloom.llm.ngram_join import SKETCH_WORDS, sketches

PARAGRAPH = re.compile(r"[^\r\n]+")
#: two line breaks in a row
BLANK = re.compile(r"\r\n\r|\n\r?\n|\r\r")
SHINGLE, SIMILARITY, RECALL, MOST_HASHES, LEAST_WORDS = 5, 0.8, 0.999, 128, 25
OCCURRENCE = "doc_id long, rid long, paragraph int, start long, stop long, n_words long, h1 long, h2 long, body binary"
#: words of an exact run, and of the pieces that find it
RUN, GRAM = 50, 26
#: kinds of passages, in the order in which they come at one place
LINE, BLOCK, EXACT = 0, 1, 2
#: neighbouring runs of a text that have one least piece: the hashes of the piece and of all their words, their number,
#: the piece's place and the first run's (in words), start, stop and line of each run, and hashes of the runs
STRETCH = "piece long, whole long, n int, place int, at long, starts array<int>, stops array<int>, lines array<int>, hashes array<long>"
STRETCH_ARROW = pa.schema(
    [("piece", pa.int64()), ("whole", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("at", pa.int64())]
    + [(c, pa.list_(pa.int32())) for c in ("starts", "stops", "lines")]
    + [("hashes", pa.list_(pa.int64()))]
)
KIND = ["piece", "whole", "n", "place"]
PLACE = f"{OCCURRENCE}, unit int, {STRETCH}"


def bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows of a band): the widest bands that still find a pair at the threshold with the wanted recall."""
    for width in range(most, 0, -1):
        p = similarity**width
        need = 1 if p >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-p)) if p > 1e-12 else most + 1
        if need * width <= most:
            return need, width
    raise ValueError("no banding of that recall within the number of hashes")


def band_slots(hashes: np.ndarray, offsets: np.ndarray, count: int, width: int) -> np.ndarray:
    """One bucket key per set and band; ``offsets`` cut ``hashes`` into sets."""
    seeds = np.arange(1, count * width + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    lows = np.full((len(offsets) - 1, count * width), np.uint64(0xFFFFFFFFFFFFFFFF))
    # blocks that stay in the processor's cache, worked on in place
    block, spare = np.empty((2, 128, count * width), np.uint64)
    for i, (first, last) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for a in range(first, last, 128):
            n = min(128, last - a)
            x, y = block[:n], spare[:n]
            np.bitwise_xor(hashes[a : a + n, None], seeds[None, :], out=x)
            _mix_into(x, y)
            np.minimum(lows[i], x.min(axis=0), out=lows[i])
    out = np.arange(1, count + 1, dtype=np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(GOLDEN) + lows[:, j::width])
    return (out & np.uint64(SLOT_MASK)).view(np.int64)


def _mix_into(x: np.ndarray, y: np.ndarray) -> None:
    """:func:`mix` in place; ``y`` has the shape of ``x``."""
    for shift, times in ((30, MIX1), (27, MIX2)):
        np.right_shift(x, np.uint64(shift), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, times, out=x)
    np.right_shift(x, np.uint64(31), out=y)
    np.bitwise_xor(x, y, out=x)


def _joined_lines(text: str, least: int):
    """(unit, number of the first line, start, stop) of the lines, and of neighbouring short lines as one block."""
    short: list = []  # number, start, stop, words of a block that may go on
    for number, m in enumerate(PARAGRAPH.finditer(text)):
        n = len(m[0].encode("utf-8", "surrogatepass").split())
        if short and (n >= least or not n or BLANK.search(text, short[2], m.start())):
            if short[3] >= least:
                yield BLOCK, *short[:3]
            short = []
        if n >= least:
            yield LINE, number, m.start(), m.end()
        elif n:
            short = [*short[:2], m.end(), short[3] + n] if short else [number, m.start(), m.end(), n]
    if short and short[3] >= least:
        yield BLOCK, *short[:3]


def least_pieces(words: np.ndarray, run: int = RUN, gram: int = GRAM) -> np.ndarray:
    """Place of the least piece (of equal ones the first) of each run of ``run`` words; no runs, no places."""
    if len(words) < run:
        return np.empty(0, np.int64)
    low, width, wide = rolled(words, gram), 1, run - gram + 1
    at = np.arange(len(low))
    while width < wide:
        step = min(width, wide - width)
        later = low[step:] < low[:-step]
        low, at = np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step])
        width += step
    return at


def stretches(words: np.ndarray, owners: np.ndarray, run: int = RUN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the least piece, first run, number of runs) of neighbouring runs with one least piece; none crosses texts."""
    places = least_pieces(words, run, gram)
    inside = np.flatnonzero(owners[: len(places)] == owners[run - 1 :][: len(places)])
    places = places[inside]
    new = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else inside
    return places[new], inside[new], np.diff(np.r_[new, len(places)])


def _bytes(column) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _pieces(run: int, gram: int):
    def count(batches):
        for batch in bounded(batches):
            hashes, owners = word_hashes(_bytes(batch.column(0)))
            places = stretches(hashes, owners, run, gram)[0]
            values, times = np.unique(rolled(hashes, gram)[places], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], names=["slot", "times"])

    return count


def _edges(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop (code points) and number of the line of every word of all texts in order."""
    letters = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, SPACE[letters], True]))
    starts, stops = edge[::2], edge[1::2]
    first = np.cumsum([0] + [len(t or b"") + 1 for t in texts])[:-1]
    text = np.searchsorted(first, starts, "right") - 1
    points = np.r_[0, np.cumsum(letters & 0xC0 != 0x80)]
    breaks = (letters == 10) | (letters == 13)
    lines = np.r_[0, np.cumsum(~breaks & np.r_[True, breaks[:-1]])] if len(letters) else np.zeros(1, int)
    return points[starts] - points[first[text]], points[stops] - points[first[text]], lines[starts + 1] - lines[first[text]] - 1


class _Stretches:
    """Rows of ``STRETCH`` for the stretches whose least piece is wanted; a task tells the hashes of equal ones once."""

    def __init__(self, wanted: SlotFilter, run: int, gram: int):
        self.wanted, self.run, self.gram = wanted, run, gram
        self.seen: set[tuple[int, int, int]] = set()

    def columns(self, batch: pa.RecordBatch) -> list[pa.Array]:
        """Of a batch of doc_id, rid, text."""
        texts = _bytes(batch.column(2))
        words, owners = word_hashes(texts)
        places, low, n = stretches(words, owners, self.run, self.gram)
        piece = rolled(words, self.gram).view(np.int64)[places]
        own = self.wanted.has(piece)
        places, low, n, piece = places[own], low[own], n[own], piece[own]
        whole = ranged(words, low, low + n + self.run - 1).view(np.int64)
        edges = np.r_[0, np.cumsum(n)]
        at = np.arange(edges[-1]) + np.repeat(low - edges[:-1], n)
        starts, stops, lines = _edges(texts) if len(at) else (at, at, at)
        text = owners[low]
        new = np.zeros(len(low), bool)
        for i, key in enumerate(zip(piece.tolist(), whole.tolist(), n.tolist(), strict=True)):
            if key not in self.seen:
                if len(self.seen) > 200_000:
                    self.seen = set()
                self.seen.add(key)
                new[i] = True
        told = np.r_[0, np.cumsum(np.where(new, n, 0))]
        hashes = rolled(words, self.run).view(np.int64)[at[np.repeat(new, n)]] if len(at) else at
        listed = lambda cut, values: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values))
        return [
            batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.array(piece), pa.array(whole), pa.array(n.astype(np.int32)),
            pa.array((places - low).astype(np.int32)), pa.array(low - np.searchsorted(owners, text)),
            listed(edges, starts[at].astype(np.int32)), listed(edges, stops[at + self.run - 1].astype(np.int32)), listed(edges, lines[at].astype(np.int32)),
            listed(told, hashes),
        ]


def _split(least: int, wanted: SlotFilter | None = None, run: int = RUN, gram: int = GRAM):
    """Lines as rows of ``OCCURRENCE``; with a filter of least pieces, lines and blocks, and rows of ``STRETCH``, as rows of ``PLACE``."""
    names = [p.split()[0] for p in (OCCURRENCE + ", unit int").split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.int64()] * 5 + [pa.binary(), pa.int32()]
    schema = pa.schema(list(zip(names, kinds, strict=True))[: None if wanted else OCCURRENCE.count(",") + 1])
    whole = pa.schema([*schema, *STRETCH_ARROW])

    def put(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in whole], schema=whole)

    def units(rows: list[tuple]) -> pa.RecordBatch:
        batch = _rows(rows, schema)
        return put(dict(zip(schema.names, batch.columns, strict=True)), len(rows)) if wanted else batch

    def split(batches):
        seen: set[tuple[int, int]] = set()
        found = _Stretches(wanted, run, gram) if wanted else None
        for batch in bounded(batches):
            rows = []
            for doc_id, rid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for unit, number, start, stop in _joined_lines(text or "", least):
                    if unit == BLOCK and not wanted:
                        continue
                    own = text[start:stop].encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters, ASCII white space
                    body = b" ".join(own)
                    digest = hashlib.blake2b(body, digest_size=16).digest()
                    key = (int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True))
                    if len(seen) > 200_000:
                        seen = set()
                    rows.append((doc_id, rid, number, start, stop, len(own), *key, None if key in seen else body, unit)[: len(schema)])
                    seen.add(key)
                if len(rows) > 20_000:
                    yield units(rows)
                    rows = []
            yield units(rows)
            if found:
                columns = found.columns(batch)
                yield put(dict(zip(["doc_id", "rid", *STRETCH_ARROW.names], columns, strict=True)) | {"unit": pa.array([EXACT] * len(columns[0]), pa.int32())}, len(columns[0]))

    return split


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _stars(parts: int):
    def run(batches):
        stars = LocalStars(parts)
        for batch in batches:
            for node, slots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stars.add(node, slots)
            if stars.full:
                yield stars.batch()
        yield stars.batch()

    return run


def _members(wanted: SlotFilter):
    def run(batches):
        for batch in batches:
            slots, ids = pc.list_flatten(batch.column(1)), batch.column(0).take(pc.list_parent_indices(batch.column(1)))
            has = pa.array(wanted.has(slots.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([slots.filter(has), ids.filter(has)], names=["slot", "id"])

    return run


def _facts(k: int, count: int, width: int):
    names = ["id", "n", *(f"s{i}" for i in range(SKETCH_WORDS)), "slots"]

    def run(batches):
        for batch in bounded(batches):
            hashes, offsets = shingles(batch.column(1).to_pylist(), k)
            short = sketches(hashes, offsets)
            cols = [pa.array(np.ascontiguousarray(short[:, i])) for i in range(SKETCH_WORDS)]
            slots = pa.array(band_slots(hashes, offsets, count, width).ravel())
            slots = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(count)), slots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), *cols, slots], names=names)

    return run


def _may(similarity: float, measure: str) -> str:
    """What every link meets: sizes close enough, and parity sketches no further apart than the sets may be."""
    if measure != "jaccard":
        return "true"
    part = round(similarity * 1000)
    apart = " + ".join(f"bit_count(l.s{i} ^ r.s{i})" for i in range(SKETCH_WORDS))
    return f"1000 * least(l.n, r.n) >= {part} * greatest(l.n, r.n) and {1000 + part} * ({apart}) <= {1000 - part} * (l.n + r.n)"


def edit_similarity(a: list[str], b: list[str]) -> float:
    """1 - word edit distance / length of the longer sequence."""
    if not a and not b:
        return 1.0
    row = np.arange(len(b) + 1)
    other = np.array(b, object)
    steps = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (other != w))
        new = np.r_[i, new]
        row = np.minimum.accumulate(new - steps) + steps
    return 1 - int(row[-1]) / max(len(a), len(b))


def _verify(k: int, similarity: float, measure: str):
    percent = round(similarity * 1000)

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if measure == "edit":
                keep = [edit_similarity(x.split(b" "), y.split(b" ")) >= similarity for x, y in zip(left, right, strict=True)]
            else:
                (x, a), (y, b) = shingles(left, k), shingles(right, k)
                keep = []
                for i in range(batch.num_rows):
                    p, q = x[a[i] : a[i + 1]], y[b[i] : b[i + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(1000 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["id", "rep"]).filter(pa.array(keep, pa.bool_()))

    return run


def repeats(
    docs: DataFrame,
    k: int = SHINGLE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    least_words: int = LEAST_WORDS,
    measure: str = "jaccard",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per occurrence of a passage that occurs more than once.

    doc_id, paragraph (number among the non-empty lines), start and stop (code points), n_words, group_doc and
    group_paragraph (first occurrence by id, then paragraph), group_size (occurrences), removed (all but the
    first). Paragraphs of fewer than ``least_words`` words are no passages. Null and empty texts have none. Rows
    repeated with one id are occurrences of their own; a null id comes after all others. An empty table gives
    an empty result; only the two named columns are read.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).cast("string").alias("text"))
    found = stage(slim.mapInArrow(_split(least_words), OCCURRENCE), "paragraphs")
    return _grouped(found, k, similarity, recall, measure).select(
        "doc_id", "paragraph", "start", "stop", "n_words", "group_doc", "group_paragraph", "group_size", "removed"
    )


def _grouped(found: DataFrame, k: int, similarity: float, recall: float, measure: str, spent: list[str] | None = None) -> DataFrame:
    """``spent``: staged folders that hold nothing but ``found``; they go as soon as its texts are told apart."""
    count, width = bands(similarity, recall)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "paragraph", "start")
    counted = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first"))
    # a body per task that has one; the smallest is any of equal texts
    bodies = found.where("body is not null").groupBy("h1", "h2").agg(F.min("body").alias("body"))
    units = counted.join(bodies, ["h1", "h2"]).withColumn("node", F.monotonically_increasing_id())
    units = stage(units.select("node", "h1", "h2", "times", "first", "body"), "units")
    if spent:
        found = stage(found.drop("body"), "places")
        release(found.sparkSession, spent)
    tidy(found.sparkSession)
    texts = units.select("node", "body")

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("l"), F.col("body").alias("lt"))
        right = texts.select(F.col("node").alias("r"), F.col("body").alias("rt"))
        joined = pairs.join(left, F.col("id") == F.col("l")).join(right, F.col("rep") == F.col("r"))
        return joined.select("id", "rep", "lt", "rt").mapInArrow(_verify(k, similarity, measure), "id long, rep long")

    shape = "id long, n long, " + ", ".join(f"s{i} long" for i in range(SKETCH_WORDS)) + ", slots array<long>"
    known = stage(texts.mapInArrow(_facts(k, count, width), shape), "facts")
    parts = parts_for(known.count() * count)
    slots = known.select("id", "slots")
    comp = link(
        slots.mapInArrow(_stars(parts), STAR),
        parts,
        lambda wanted: slots.mapInArrow(_members(wanted), "slot long, id long"),
        known.drop("slots"),
        _may(similarity, measure),
        verify,
    ).select(F.col("node").alias("n"), "component")
    own = units.drop("body").join(comp, F.col("node") == F.col("n"), "left").withColumn("component", F.coalesce("component", "node"))
    own = stage(own.select("h1", "h2", "times", "first", "component"), "units")
    groups = own.groupBy("component").agg(F.sum("times").alias("group_size"), F.min("first").alias("head")).where("group_size > 1")
    keyed = own.select("h1", "h2", "component").join(groups, "component").select("h1", "h2", "group_size", "head")
    joined = found.drop("body").join(keyed, ["h1", "h2"])
    is_head = (F.col("rid") == F.col("head.rid")) & (F.col("paragraph") == F.col("head.paragraph"))
    return joined.select(
        "*", F.col("head.doc_id").alias("group_doc"), F.col("head.paragraph").alias("group_paragraph"), (~is_head).alias("removed")
    )


def passages(
    docs: DataFrame,
    k: int = SHINGLE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    least_words: int = LEAST_WORDS,
    run: int = RUN,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per occurrence of a repeated passage, wherever lines break; columns of :func:`repeats`, and ``unit``.

    unit is ``line`` or ``block`` (neighbouring lines of fewer than ``least_words`` words each, with no blank line
    between, that have as many together) for near copies, and ``run`` for equal words: neighbouring runs of ``run``
    words that occur more than once, all removed with their first occurrences in one document, or all first
    occurrences, form one row. Every such run lies in a row: of unit ``run``, or in a line or block that has the
    same ``removed``. paragraph is the line in which a row starts; group_size of a ``run`` counts its most
    frequent words, group_doc and group_paragraph tell where its first words occur first. Words of a first
    occurrence that a later one overlaps in the same text are not removed. Nulls and repeated rows as in
    :func:`repeats`.
    """
    prepare(docs.sparkSession)
    if run < 2:
        raise ValueError("a run has two words at least")
    gram = run // 2 + 1
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).cast("string").alias("text"))
    pieces = slim.select("text").mapInArrow(_pieces(run, gram), "slot long, times long")
    wanted = SlotFilter.of(pieces.groupBy("slot").agg(F.sum("times").alias("times")).where("times > 1"))
    found = stage(slim.mapInArrow(_split(least_words, wanted, run, gram), PLACE), "passages")
    spent = staged()[-1:]
    tidy(docs.sparkSession)
    cols = ["doc_id", "rid", "paragraph", "start", "stop", "n_words", "group_doc", "group_paragraph", "group_size", "removed"]
    names = F.when(F.col("unit") == LINE, "line").otherwise("block")
    exact = _spans(found.where(F.col("unit") == EXACT).select("doc_id", "rid", *STRETCH_ARROW.names), run).select(*cols, F.lit("run").alias("unit"))
    units = found.where(F.col("unit") != EXACT).drop(*STRETCH_ARROW.names)
    near = stage(_grouped(units, k, similarity, recall, "jaccard", spent).select(*cols, names.alias("unit")), "near")
    around = near.select(F.col("rid").alias("o_rid"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"), F.col("removed").alias("o_removed"))
    inside = F.expr("rid = o_rid and removed = o_removed and start >= o_start and stop <= o_stop")
    return near.unionByName(exact.join(around, inside, "left_anti")).drop("rid")


def _heads(found: DataFrame) -> DataFrame:
    """For each kind of stretch (``KIND``) its parts ``low`` to ``high`` whose runs first occur side by side: the most times
    that one occurs, and where the part occurs first.

    Stretches of equal words are one kind. A piece of one kind has no run of another; only runs of pieces with several are compared.
    """
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "at", "lines", "stops")
    kinds = found.groupBy(*KIND).agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("head"), F.max("hashes").alias("hashes"))
    kinds = stage(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    tidy(found.sparkSession)
    several = kinds.groupBy("piece").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("piece")
    place = [F.col("head.none").alias("none"), F.col("head.doc_id").alias("head_doc"), F.col("head.rid").alias("head_rid")]
    alone = kinds.join(several, "piece", "left_anti").where("times > 1")
    alone = alone.select(
        *KIND, F.lit(0).alias("low"), (F.col("n") - 1).alias("high"), "times", *place[1:], F.col("head.at").alias("head_at"),
        F.col("head.lines")[0].alias("head_line"), F.element_at("head.stops", -1).alias("head_stop"),
    )
    each = kinds.join(several, "piece", "left_semi").select("kind", "piece", "place", "times", "head", F.posexplode("hashes").alias("i", "hash"))
    same = ["piece", "before", "hash"]
    each = each.withColumn("before", F.col("place") - F.col("i"))
    line, stop = F.col("head.lines")[F.col("i")], F.col("head.stops")[F.col("i")]
    first = F.struct(*place, (F.col("head.at") + F.col("i")).alias("at"), line.alias("line"), stop.alias("stop"))
    runs = each.groupBy(*same).agg(F.sum("times").alias("times"), F.min(first).alias("first")).where("times > 1")
    of = each.select("kind", "i", *same).join(runs, same)
    along = Window.partitionBy("kind").orderBy("i")
    was = lambda c: F.lag(c).over(along)
    on = (was("i") == F.col("i") - 1) & (was("first.head_rid") == F.col("first.head_rid")) & (was("first.at") == F.col("first.at") - 1)
    of = of.withColumn("part", F.sum(F.when(on, 0).otherwise(1)).over(along))
    parts = of.groupBy("kind", "part").agg(
        F.min("i").alias("low"), F.max("i").alias("high"), F.max("times").alias("times"), F.min_by("first", "i").alias("first"), F.max_by("first.stop", "i").alias("head_stop")
    )
    parts = parts.join(kinds.select("kind", *KIND), "kind").select(
        *KIND, "low", "high", "times", "first.head_doc", "first.head_rid", F.col("first.at").alias("head_at"), F.col("first.line").alias("head_line"), "head_stop"
    )
    heads = stage(alone.unionByName(parts), "heads")
    tidy(found.sparkSession)
    return heads


def _spans(found: DataFrame, run: int) -> DataFrame:
    """Neighbouring repeated runs of one text as one row; ``found`` has doc_id, rid and the columns of ``STRETCH``."""
    before = staged()
    heads = _heads(found)
    own = [path for path in staged() if path not in before]
    here = [(F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high")]
    spot = [F.col("starts")[F.col("low")].alias("start"), F.col("stops")[F.col("high")].alias("stop"), F.col("lines")[F.col("low")].alias("paragraph")]
    of = found.drop("hashes").join(heads, KIND).select("doc_id", "rid", *here, *spot, "times", "head_doc", "head_rid", "head_at", "head_line", "head_stop")
    of = of.withColumn("removed", (F.col("rid") != F.col("head_rid")) | (F.col("low") != F.col("head_at")))
    along = Window.partitionBy("rid").orderBy("low")
    was = lambda c: F.lag(c).over(along)
    same = (was("high") == F.col("low") - 1) & (was("removed") == F.col("removed")) & (was("head_rid") == F.col("head_rid"))
    of = of.withColumn("span", F.sum(F.when(same, 0).otherwise(1)).over(along))
    # where a text repeats itself, the words of the first occurrence stay
    last = F.struct((F.col("head_at") + F.col("high") - F.col("low")).alias("at"), F.col("head_stop").alias("stop"))
    first = lambda c: F.min_by(c, "low")
    spans = of.groupBy("rid", "span").agg(
        first("doc_id").alias("doc_id"), first("paragraph").alias("paragraph"), F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"),
        F.min("low").alias("low"), (F.max("high") + run).alias("high"), F.max(F.when(F.col("removed") & (F.col("rid") == F.col("head_rid")), last)).alias("own"),
        F.max("times").alias("group_size"), first("head_doc").alias("group_doc"), first("head_line").alias("group_paragraph"), F.first("removed").alias("removed"),
    )
    low = F.greatest("low", F.coalesce(F.col("own.at") + run, "low"))
    start = F.greatest("start", F.coalesce(F.col("own.stop").cast("long"), "start"))
    spans = stage(spans.withColumn("start", start).withColumn("n_words", F.col("high") - low).where("n_words > 0"), "spans")
    release(found.sparkSession, own)
    tidy(found.sparkSession)
    return spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all rows and columns, with the repeated passages cut from their texts (see :func:`repeats`).

    The line break after a removed paragraph goes with it. Rows are told apart by content, so ``docs`` is
    written to the shared folder once.
    """
    prepare(docs.sparkSession)
    rid, gone, body = fresh(docs.columns, "_rid", "_gone", "_cut")
    held = stage(docs.withColumn(rid, F.monotonically_increasing_id()), "docs")
    given = {"k": SHINGLE, "similarity": SIMILARITY, "recall": RECALL, "measure": "jaccard", "least_words": LEAST_WORDS} | options
    slim = held.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(rid).alias("rid"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = stage(slim.mapInArrow(_split(given.pop("least_words")), OCCURRENCE), "paragraphs")
    cut = _grouped(found, **given).where("removed").groupBy("rid").agg(F.collect_set("paragraph").alias(gone)).withColumnRenamed("rid", body + "_rid")

    @F.pandas_udf("string")
    def rest(texts, numbers):
        import pandas as pd

        return pd.Series([_cut(t, n) for t, n in zip(texts, numbers, strict=True)])

    joined = held.join(cut, F.col(rid) == F.col(body + "_rid"), "left")
    new = F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(rest(F.col(f"`{text_col}`").cast("string"), F.coalesce(gone, F.array().cast("array<int>"))))
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def _cut(text, numbers) -> str | None:
    if text is None or not len(numbers):
        return text
    gone, out, at = set(int(n) for n in numbers), [], 0
    for number, m in enumerate(PARAGRAPH.finditer(text)):
        if number in gone:
            out.append(text[at : m.start()])
            at = m.end() + (text[m.end() : m.end() + 1] == "\r" and text[m.end() + 1 : m.end() + 2] == "\n")
            at += text[at : at + 1] in ("\n", "\r")
    return "".join([*out, text[at:]])
