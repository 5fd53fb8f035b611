"""Helpers the corpus operators share: staged tables, hashing of words, batch sizes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tapeloom.session import scratch_path

#: rows of one Arrow batch; texts may be very long
BATCH_ROWS = 512
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def prepare(spark: SparkSession) -> SparkSession:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


#: bytes of texts that a task works on at a time; a longer text comes alone
BATCH_BYTES = 4 << 20


def bounded(batches):
    """Batches cut so that their columns hold about ``BATCH_BYTES``, however long the texts are."""
    for batch in batches:
        if batch.nbytes <= BATCH_BYTES:
            yield batch
            continue
        sizes = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if not pa.types.is_primitive(c.type)), np.zeros(batch.num_rows, np.int64))
        low, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > low and size + n > BATCH_BYTES:
                yield batch.slice(low, i - low)
                low, size = i, 0
            size += n
        yield batch.slice(low)


def thrifty(run):
    """``run`` for mapInArrow, after which the worker, that goes on to other tasks, gives its free memory back."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # a C library without it

    return wrapped


#: folders that :func:`stage` has written and :func:`release` has not removed
_staged: list[str] = []


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder (``spark.checkpoint.dir``) and go on from the files."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    _staged.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> list[str]:
    return list(_staged)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove staged folders whose readers are done."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        if path in _staged:
            _staged.remove(path)
            folder = hadoop(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage, after which Spark drops the shuffle files of finished jobs.

    The scheduler lets go of a job a moment after its end, so a single round right then would leave its files.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def fresh(columns, *names: str) -> list[str]:
    """Internal column names that clash with none of ``columns`` (names compare without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """Lower-cased (A-Z only) runs of characters other than ASCII white space."""
    return WORD.findall(text.translate(ASCII_LOWER)) if text else []


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z count as a-z
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
#: bytes hashed at a time; texts are cut at white space, and the hash of a word doesn't depend on its place
PIECE_BYTES = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(n, np.uint64(base))
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word: a polynomial in the letters' random values, from prefix sums."""
    letters = np.frombuffer(text, np.uint8)
    space = SPACE[letters]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True]))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    up, down = _grown(len(letters))
    sums = np.cumsum(_LETTERS[letters] * up[: len(letters)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    value = (sums[stops - 1] - before) * down[starts]
    return mix(value + mix((stops - starts).astype(np.uint64) * np.uint64(GOLDEN))), starts


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the text each belongs to."""
    hashes, owners, at = [], [], 0
    while at < len(texts):
        part, size, first = [], 0, at
        while at < len(texts) and (not part or size + len(texts[at] or b"") < PIECE_BYTES):
            part.append(texts[at] or b"")
            size += len(part[-1]) + 1
            at += 1
        if size <= PIECE_BYTES + 1:
            h, starts = _hashed(b" ".join(part))
            lows = np.cumsum([0] + [len(p) + 1 for p in part])
            hashes.append(h)
            owners.append(np.searchsorted(lows, starts, "right") - 1 + first)
            continue
        text, low = part[0], 0  # one long text
        while low < len(text):
            high = low + PIECE_BYTES
            while high < len(text) and not SPACE[text[high]]:
                high += 1
            h, _ = _hashed(text[low:high])
            hashes.append(h)
            owners.append(np.full(len(h), first))
            low = high
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners).astype(np.int64)


def shingles(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of every text's ``k``-word shingles, sorted within the text, and the texts' offsets.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer words has its whole
    sequence as one shingle, a text without words none.
    """
    w, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
    first = np.r_[0, np.cumsum(count)]
    spread = np.maximum(count - k + 1, np.minimum(count, 1))
    offsets = np.r_[0, np.cumsum(spread)]
    doc = np.repeat(np.arange(len(texts)), spread)
    at = np.arange(len(doc)) - offsets[doc] + first[doc]
    width = np.minimum(count, k)[doc]
    total = width.astype(np.uint64)
    for j in range(k):
        if j == 0 or (width > j).all():
            total = mix(total * np.uint64(GOLDEN) + w[at + j]) if len(at) else total
        else:
            more = width > j
            total[more] = mix(total[more] * np.uint64(GOLDEN) + w[at[more] + j])
    for d in np.flatnonzero(spread > 1).tolist():
        total[offsets[d] : offsets[d + 1]].sort()
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    kept = np.bincount(doc[new], minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
    return total[new], np.r_[0, np.cumsum(kept)]


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of ``k`` words, by prefix sums; ``words`` are hashes of one text's words in order."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    up, down = _grown(len(words) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)])]
    return mix((sums[k:] - sums[:-k]) * down[: len(words) - k + 1])


def ranged(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64-bit hash of the words from each ``low`` up to its ``high``, as :func:`rolled` gives for one length."""
    up, down = _grown(len(words) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)])]
    return mix((sums[high] - sums[low]) * down[low])
