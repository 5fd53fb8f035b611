"""Best-fit packing of token pieces by linear grouping.

All lengths lie between 1 and the capacity, so a corpus is known to the plan as a histogram of at most
``capacity`` counts, whatever its size. The plan runs on that histogram: large lengths, sorted, are cut into
groups of equal cardinality and rounded up to the largest of their group; for these few sizes the best
configurations of a sequence come from column generation (a linear program whose columns are knapsack
solutions). Then actual lengths are put in the places of the rounded ones, and what is left over and the small
lengths go where they fit best. The outcome is a table of runs: pieces of one length with ranks r..r+n go to
sequences s..s+n at one offset. Spark tokenizes, ranks the pieces of every length in two levels (inside a task,
then over the tasks' counts) and looks each piece up in the runs.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tapeloom.llm.common import prepare, stage

CAPACITY = 4096
GROUPS = 48
#: lengths of at least this share of the capacity count as large; the plan with the fewest sequences is taken
LARGE = (1 / 2, 1 / 3, 1 / 4, 1 / 8)
#: a word and the punctuation that follows it are tokenized apart, and so are the cases of a plain word
PUNCTUATION = b".,!?;:#$%&*()\"/-"
#: words tokenized at a time
WORDS = 100
#: marks the tokens that end a word in the vocabulary
WORD_END = "</w>"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def chunks(text: bytes | None) -> list[bytes]:
    """What ASCII white space parts; a text of ASCII letters is lower-cased first, as the tokenizer does."""
    if not text:
        return []
    return (text.lower() if text.isascii() and b"<|" not in text else text).split()


class WordIds(dict):
    """White-space delimited chunk -> its ids as little-endian bytes, by the tokenizer. Holds a fixed number of chunks.

    Chunks split at ASCII white space, which this family of tokenizers drops, and where a letter meets ASCII
    punctuation other than an apostrophe, where its pre-tokenizer splits too. So the ids of a text are the ids
    of its chunks in order.
    """

    #: chunks of one generation; when it is full it becomes the old one, of which used chunks are taken over
    LIMIT = 300_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.old = Tokenizer.from_file(path), {}
        # lower-case ASCII words pass its normaliser and pre-tokenizer unchanged, so the model alone gives their ids
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def learn(self, texts: list[list[bytes]]) -> None:
        """Tokenize the unknown plain words of a batch in one go: each ends with the first word-end token."""
        new: set[bytes] = set()
        for own in texts:
            new.update(filterfalse(self.__contains__, own))
        if self.old:
            # one lookup per new chunk: intersection would walk the whole old generation
            old = {c: self.old[c] for c in filter(self.old.__contains__, new)}
            self.update(old)
            new.difference_update(old)
        if not new:
            return
        parts, plain = [], set()
        for chunk in new:
            head = chunk.rstrip(PUNCTUATION)
            if head.isalpha():  # of bytes: ASCII letters
                word = head.lower()
            elif head.isascii() or not head.decode().isalpha():
                continue
            else:
                word = head
            plain.add(word)
            if word != chunk:
                parts.append((chunk, word, chunk[len(head) :]))
        todo = plain.difference(self)
        ascii_words = [w for w in todo if w.isascii()]
        for words, tokenizer in ((ascii_words, self.bare), (list(todo.difference(ascii_words)), self.tokenizer)):
            for i in range(0, len(words), WORDS):
                part = words[i : i + WORDS]
                ids = self._encode(b" ".join(part).decode(), tokenizer)
                stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(stops) == len(part):  # else a letter to one is none to the other, and words go one by one
                    body = ids.tobytes()
                    self.update((w, body[a:b]) for w, a, b in zip(part, [0, *stops], stops, strict=False))
        for chunk, word, tail in parts:
            self[chunk] = self[word] + self[tail] if tail else self[word]

    def forget(self) -> None:
        """Between batches: start a new generation when this one is full."""
        if len(self) >= self.LIMIT:
            self.old = dict(self)
            self.clear()

    @staticmethod
    def _parts(chunk: bytes) -> tuple[bytes | None, bytes]:
        """(plain word, ASCII punctuation after it); no word where the chunk must stay whole."""
        head = chunk.rstrip(PUNCTUATION)
        text = head.decode()
        if not text.isalpha():
            return None, b""
        return head.lower() if text.isascii() else head, chunk[len(head) :]

    def _encode(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def __missing__(self, chunk: bytes) -> bytes:
        value = self.old.get(chunk)
        if value is None:
            word, tail = self._parts(chunk)
            value = self._encode(chunk.decode()).tobytes() if word in (None, chunk) else self[word] + (self[tail] if tail else b"")
        if len(chunk) <= 200:
            self[chunk] = value
        return value


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table per Python worker, which serves many tasks."""
    return WordIds(path)


def _pieces(path: str, capacity: int, last_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32())] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "task", "nth")])
    end = int(last_id).to_bytes(4, "little")

    def run(batches):
        ids, task, count = word_ids(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            texts = [chunks(text) for text in batch.column(1).cast(pa.binary()).to_pylist()]
            ids.forget()
            ids.learn(texts)
            for doc_id, own in zip(batch.column(0).to_pylist(), texts, strict=True):
                body = b"".join(map(ids.__getitem__, own)) + end
                for piece, at in enumerate(range(0, len(body) // 4, capacity)):
                    part = body[4 * at : 4 * (at + capacity)]
                    n = len(part) // 4
                    rows.append((doc_id, piece, at, n, zlib.crc32(part), task, count[n]))
                    count[n] += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, last_id: int = 1) -> DataFrame:
    """Pieces of at most ``capacity`` ids with their crc and their rank among the task's pieces of that length."""
    return docs.mapInArrow(_pieces(path, capacity, last_id), PIECE)


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of ``sizes`` within ``capacity``."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for j, (s, v) in enumerate(zip(sizes, values, strict=True)):
        if v <= 1e-12:
            continue
        for _ in range(capacity // s):
            gain = best[:-s] + v
            better = gain > best[s:] + 1e-12
            if not better.any():
                break
            best[s:] = np.where(better, gain, best[s:])
            choice[s:][better] = j
    # walk back; a choice may rest on one that was improved later, so values only grow on the way
    counts, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        j = choice[room]
        if j < 0:
            break
        counts[j] += 1
        room -= sizes[j]
    return float(counts @ values), counts


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(counts per size, times): whole parts of the optimum of the configuration program over ``sizes``."""
    k = len(sizes)
    if not k:
        return []
    columns = [np.eye(k, dtype=int)[j] * (capacity // sizes[j]) for j in range(k)]
    base, need = np.array(columns, float).T, np.array(demand, float)
    inverse = np.linalg.inv(base)
    x = inverse @ need
    for step in range(40 * k):
        value, new = _knapsack(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ new
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        columns[out], base[:, out] = new, new
        x = np.maximum(x - ratio[out] * direction, 0)
        x[out] = ratio[out]
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        if step % 25 == 24:
            inverse = np.linalg.inv(base)
            x = np.maximum(inverse @ need, 0)
    return [(c, int(n + 1e-6)) for c, n in zip(columns, x, strict=True) if int(n + 1e-6) > 0]


class Runs:
    """Pieces taken from the histogram in rank order, and the runs that place them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.used, self.rows, self.sequences = dict(counts), Counter(), [], 0
        #: room -> intervals of sequences (first, number) with that room
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        self.capacity = capacity

    def put(self, length: int, first: int, n: int, room: int) -> None:
        """``n`` pieces of ``length`` into sequences first.. with ``room`` left, one each."""
        self.rows.append((length, self.used[length], n, first, self.capacity - room))
        self.used[length] += n
        self.left[length] -= n

    def opened(self, first: int, n: int, room: int) -> None:
        if room and n:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((first, n))

    def configuration(self, groups: list[list[int]], counts: np.ndarray, times: int) -> None:
        """Open ``times`` sequences and fill each with ``counts[g]`` actual pieces of every group."""
        spans = [(self.sequences, times, self.capacity)]
        self.sequences += times
        for g, many in enumerate(counts):
            for _ in range(many):
                new = []
                for first, n, room in spans:
                    while n and groups[g]:
                        length = groups[g][0]
                        take = min(n, self.left[length])
                        if not take:
                            groups[g].pop(0)
                            continue
                        self.put(length, first, take, room)
                        new.append((first, take, room - length))
                        first, n = first + take, n - take
                    if n:
                        new.append((first, n, room))
                spans = new
        for first, n, room in spans:
            self.opened(first, n, room)

    def best_fit(self, length: int) -> None:
        """All that is left of ``length``: each piece where the least room remains, else in a new sequence."""
        while self.left[length]:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                n = -(-self.left[length] // (self.capacity // length))
                self.opened(self.sequences, n, self.capacity)
                self.sequences += n
                continue
            room = self.rooms[at]
            first, n = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                self.rooms.pop(at)
            take = min(n, self.left[length])
            self.put(length, first, take, room)
            self.opened(first + take, n - take, room)
            self.opened(first, take, room - length)


def _plan(counts: dict[int, int], capacity: int, groups: int, large: float) -> tuple[list[tuple], int]:
    runs = Runs(counts, capacity)
    full = counts.get(capacity, 0)
    if full:
        runs.put(capacity, 0, full, capacity)
        runs.sequences = full
    big = sorted((n for n in counts if large * capacity <= n < capacity), reverse=True)
    total = sum(counts[n] for n in big)
    share = max(1, -(-total // groups))
    # equal-cardinality groups of the sorted large lengths; a length that spans a border stays with the upper group
    parts: list[list[int]] = []
    demand: list[int] = []
    for n in big:
        if not parts or demand[-1] >= share:
            parts.append([])
            demand.append(0)
        parts[-1].append(n)
        demand[-1] += counts[n]
    sizes = [p[0] for p in parts]
    for column, times in configurations(sizes, demand, capacity):
        runs.configuration(parts, column, times)
    for n in sorted(counts, reverse=True):
        runs.best_fit(n)
    return runs.rows, runs.sequences


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large=LARGE) -> tuple[list[tuple], int]:
    """Runs (length, first rank, number, first sequence, offset) for a histogram of lengths, and the number of sequences."""
    return min((_plan(counts, capacity, groups, share) for share in large), key=lambda p: p[1])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty; every document ends with one closing id, so each has a piece. Rows repeated
    with one id and rows with a null id are packed on their own. An empty table has no pieces. Only the two
    named columns are read.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = stage(pieces(slim, path, capacity), "pieces")
    sums = cut.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sums = stage(sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "counts")
    counts = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan(counts, capacity)
    rows.sort()
    lengths, ranks, firsts, offsets = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 3, 4))
    order = (lengths << np.int64(46)) | ranks

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length, rank):
        import pandas as pd

        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(order, (n << np.int64(46)) | r, "right") - 1
        return pd.DataFrame({"sequence_id": firsts[at] + r - ranks[at], "offset": offsets[at]})

    base = sums.select(F.col("task").alias("t"), F.col("length").alias("l"), "base")
    joined = cut.join(base, (F.col("task") == F.col("t")) & (F.col("length") == F.col("l")))
    placed = joined.withColumn("at", place("length", F.col("nth") + F.col("base")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
