"""Spelling variants by blocked Gram matrices of letter counts.

Two words one edit apart have letter counts whose squared distance is 1 (a letter more or less) or 2 (one
replaced), and the same holds for counts of letter classes. So words are dealt into blocks by length and class
counts, and a block only meets blocks whose counts may belong to one edit: adjacent lengths, or equal ones. Inside a pair of blocks
a matrix product gives all squared distances of letter counts, and what lies within two is verified on the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import prepare, stage
from tapeloom.llm.grouped import dealt, gathered, runs

RUN = re.compile("[a-zÀ-ÿ]+")
#: every so many-th run loses a letter (a fixed rule of the input, see ``counts``)
DAMAGED = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: letter classes of a block, by code point modulo their number
CLASSES = 4
#: words of a block's chunk, and distinct words that a task holds
CHUNK, HELD_WORDS = 4096, 300_000
#: rows of the left side of one product; bounds its matrix
ROWS = 1024
#: letters compared at a time
VERIFIED = 2_000_000
#: code points that occur: a-z and U+00C0 to U+00FF
LETTERS = np.zeros(256, np.int64)
LETTERS[97:123] = np.arange(26)
LETTERS[192:256] = np.arange(26, 90)


def _words(least_length: int, damaged: int):
    def out(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        found, crc = Counter(), zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                # bytes.lower() changes A-Z alone
                own = Counter(RUN.findall(text.lower().decode()))
                salt = crc(f"{'' if doc_id is None else doc_id}:".encode())
                for word in [w for w in own if not crc(w.encode(), salt) % damaged]:
                    at, n = crc(word.encode(), salt) % len(word), own.pop(word)
                    shorter = word[:at] + word[at + 1 :]
                    # several runs may end as one word; a damaged run is never damaged again
                    if len(shorter) >= least_length:
                        found[shorter] += n
                for word, n in own.items():
                    if len(word) >= least_length:
                        found[word] += n
                if len(found) > HELD_WORDS:
                    yield out(found)
                    found.clear()
        yield out(found)

    return run


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """word, n: words of at least ``least_length`` letters with at least ``least_count`` occurrences.

    A run of letters is lower-cased (A-Z only); let h be the crc32 of ``<doc_id>:<run>``. If ``damaged`` divides h,
    the run loses its letter number ``h % length``.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    rows = slim.toDF("id", "text").mapInArrow(_words(least_length, damaged), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, padded with zeros; lengths)."""
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.zeros((len(words), int(lengths.max(initial=1))), np.uint8)
    points[np.arange(points.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return points, lengths


def histogram(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Letter counts, one row per word."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    flat = points[np.arange(points.shape[1]) < lengths[:, None]]
    return np.bincount(row * 90 + LETTERS[flat], minlength=90 * len(lengths)).reshape(-1, 90).astype(np.float32)


def one_edit(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Of pairs of words (rows of code points and lengths) those exactly one edit apart."""
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (a, b))
    at = np.arange(wide)
    short = np.minimum(la, lb)
    head = ((a == b) & (at < short[:, None])).cumprod(axis=1, dtype=np.int64).sum(axis=1)
    back = lambda x, n: np.take_along_axis(x, np.maximum(n[:, None] - 1 - at, 0), axis=1)
    tail = ((back(a, la) == back(b, lb)) & (at < short[:, None])).cumprod(axis=1, dtype=np.int64).sum(axis=1)
    same = la == lb
    return np.where(same, head + tail == la - 1, (np.abs(la - lb) == 1) & (head + tail >= short))


NEAR = pa.schema([("word", pa.string()), ("other", pa.string()), ("m", pa.int64())])


def _block(table: pa.Table) -> pa.Table:
    """Both directions of every near pair between the sides of one pair of blocks."""
    words, n, side = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("side").to_numpy()
    points, lengths = letters(words)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return NEAR.empty_table()
    counts = histogram(points, lengths)
    norm, found = (counts**2).sum(axis=1), []
    for low in range(0, len(left), ROWS):
        own = left[low : low + ROWS]
        gram = counts[own] @ counts[right].T
        gram *= -2
        gram += norm[own][:, None]
        gram += norm[right]
        i, j = np.nonzero(gram <= 2)
        i, j = own[i], right[j]
        # rows of side 2 stand on both sides: each pair once
        once = (side[i] != 2) | (side[j] != 2) | (i < j)
        i, j = i[once], j[once]
        part = max(1, VERIFIED // points.shape[1])
        for cut in range(0, len(i), part):
            a, b = i[cut : cut + part], j[cut : cut + part]
            true = one_edit(points[a], lengths[a], points[b], lengths[b])
            found.append((a[true], b[true]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
    names = table.column("word").combine_chunks()
    a, b = pa.array(np.r_[i, j]), pa.array(np.r_[j, i])
    return pa.Table.from_arrays([names.take(a), names.take(b), pa.array(n[np.r_[j, i]])], schema=NEAR)


def near(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """word, other, m: each two of ``words`` (word, n) one edit apart, in both directions; m is the other's n."""
    marks = [F.length(F.translate("word", "".join(chr(c) for c in [*range(97, 123), *range(192, 256)] if c % CLASSES != k), "")).cast("int") for k in range(CLASSES)]
    placed = words.select("word", "n", F.array(*marks).alias("at"))
    block = lambda c: F.concat_ws(".", F.transform(c, lambda e: e.cast("string")))
    placed = stage(placed.withColumn("block", block("at")), "blocks")
    sizes = stage(placed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), "sizes")
    plus = lambda k: F.array(*[F.col("at")[c] + int(c == k) for c in range(CLASSES)])
    minus = lambda k: F.array(*[F.col("at")[c] - int(c == k) for c in range(CLASSES)])
    swap = lambda a, b: F.array(*[F.col("at")[c] + int(c == a) - int(c == b) for c in range(CLASSES)])
    beside = [plus(k) for k in range(CLASSES)] + [minus(k) for k in range(CLASSES)]
    beside += [swap(a, b) for a in range(CLASSES) for b in range(CLASSES) if a != b]
    rows = placed.join(sizes, "block").withColumn("cut", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    own = F.expr("transform(sequence(0, chunks - 1), o -> struct(block AS ka, block AS kb, least(cut, o) AS a, greatest(cut, o) AS b, if(cut = o, 2, int(cut > o)) AS side))")
    inner = rows.select("word", "n", F.explode(own).alias("m"))
    outer = rows.select("word", "n", "block", "cut", F.explode(F.array(*[block(b) for b in beside])).alias("other"))
    # blocks that don't occur drop out here
    outer = outer.join(sizes.select(F.col("block").alias("other"), F.col("chunks").alias("ochunks")), "other")
    meets = F.expr(
        "transform(sequence(0, ochunks - 1), o -> if(block < other, struct(block AS ka, other AS kb, cut AS a, o AS b, 0 AS side), "
        "struct(other AS ka, block AS kb, o AS a, cut AS b, 1 AS side)))"
    )
    both = inner.unionByName(outer.select("word", "n", F.explode(meets).alias("m")))
    both = both.select(F.concat_ws(":", "m.ka", "m.kb", "m.a", "m.b").alias("pair"), "word", "n", F.col("m.side").cast("int").alias("side"))
    schema = "word string, other string, m long"
    return dealt(both, "pair").mapInArrow(lambda batches: gathered(map(_block, runs(batches, "pair")), 20_000, NEAR), schema)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, **rules: int) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``counts`` (``rules`` are its parameters).

    Two words are near if exactly one inserted, deleted or replaced letter parts them. A word's form is its near
    word of largest n (ties: the first in code-point order) if that n is at least twice the word's own; else null,
    and so is form_n. Following forms from a word ends at its root, the word itself if it has no form. Null texts
    hold no words, a null id counts as ''; rows with one id are separate documents; an empty table gives no rows;
    extra columns are not read. A word has a bounded number of possible near words, so no group grows.
    """
    prepare(docs.sparkSession)
    words = stage(counts(docs, id_col, text_col, **rules), "words")
    links = near(words, chunk)
    # the largest n first, then the smallest word: a minimum over (-m, other)
    best = F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best")
    own = words.join(links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "word", "left")
    twice = -F.col("best.m") >= RATIO * F.col("n")
    own = own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(twice, F.col("best.other")).alias("form"), F.when(twice, -F.col("best.m")).alias("form_n"))
    own = stage(own, "forms")
    # n at least doubles along forms, so paths are short and never closed; each round doubles the steps
    up = stage(own.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        over = up.select(F.col("word").alias("via"), F.col("root").alias("next"))
        longer = stage(up.join(over, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if longer.where("moved").isEmpty():
            break
        up = longer.select("word", "root")
    return own.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
