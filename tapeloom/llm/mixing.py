"""Mixing to target weights by iterative proportional fitting.

The corpus is known to the fit as a table of cells (source, language, topic) with their tokens. A value that
no target names falls into the class ``other`` of its dimension, so the targets bound the number of cells,
whatever the corpus holds. Raking multiplies the cells' factors until every margin of factor x tokens meets
its target shares; inclusion probabilities are factor x constant, capped at 1, with the constant solved for the
token budget. A document is taken when a hash of its id falls below its cell's probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import WORD, fresh, prepare, stage, thrifty

OTHER = "other"
TOPICS = 8
#: words shorter than this say nothing about a topic
TOPIC_LETTERS = 5
ROUNDS, TOLERANCE = 200, 1e-10


class TopicOf(dict):
    """Word -> number of its topic, or the number of topics for words that say nothing. Holds a fixed number of words."""

    LIMIT = 300_000

    def __init__(self, topics: int):
        self.topics = topics

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        plain = word.strip(".,;:!?\"'()#$%&*|").lower()
        self[word] = value = zlib.crc32(plain.encode("utf-8", "surrogatepass")) % self.topics if len(plain) >= TOPIC_LETTERS else self.topics
        return value


def measure(text: str | None, topic_of: TopicOf) -> tuple[int, str]:
    """(tokens, topic): white-space words of the whole text, and the hashed vocabulary with most of its longer words."""
    words = WORD.findall(text) if text else []
    votes = Counter(map(topic_of.__getitem__, words))
    votes.pop(topic_of.topics, None)
    if not votes:
        return len(words), OTHER
    return len(words), f"topic{min(votes, key=lambda t: (-votes[t], t))}"


def _measure(topics: int, dims: int):
    def run(batches):
        topic_of = TopicOf(topics)
        for batch in batches:
            found = [measure(t, topic_of) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())],
                names=[*batch.schema.names[1:], "tokens", "topic"],
            )

    return thrifty(run)


def shares(targets: Mapping[str, float]) -> dict[str, float]:
    """Shares that add up to 1. What no name takes goes to ``other``."""
    if any(v < 0 for v in targets.values()):
        raise ValueError("target weights can't be negative")
    named = {k: float(v) for k, v in targets.items() if k != OTHER}
    rest = float(targets.get(OTHER, 0.0))
    total = sum(named.values()) + rest
    if total <= 0:
        raise ValueError("target weights must add up to more than 0")
    return {k: v / total for k, v in (named | {OTHER: rest}).items()}


def rake(cells: list[tuple], tokens: np.ndarray, targets: list[Mapping[str, float]]) -> np.ndarray:
    """Factors of the cells for which each margin of factor x tokens has its target shares.

    Targets of values that hold no token are dealt to the others in proportion; a target of 0 empties its value.
    Margins that contradict each other on the cells at hand are met as well as the rounds allow.
    """
    tokens = np.asarray(tokens, float)
    mass = tokens / tokens.sum() if tokens.sum() else tokens.copy()
    plans = []
    for d, want in enumerate(targets):
        names = sorted({c[d] for c in cells})
        at = np.array([names.index(c[d]) for c in cells])
        there = np.bincount(at, mass, len(names)) > 0
        goal = np.where(there, [want.get(n, 0.0) for n in names], 0.0)
        if goal.sum() <= 0:
            raise ValueError(f"no target of dimension {d} names a value with tokens")
        plans.append((at, goal / goal.sum()))
    for _ in range(ROUNDS):
        off = 0.0
        for at, goal in plans:
            now = np.bincount(at, mass, len(goal))
            off = max(off, float(np.abs(now - goal).max()))
            mass = mass * np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)[at]
        if off < TOLERANCE:
            break
    return np.divide(mass * tokens.sum(), tokens, out=np.zeros(len(tokens)), where=tokens > 0)


def calibrated(factors: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """min(1, c x factor) with c such that the expected tokens meet the budget, or 1 wherever a factor is positive."""
    factors, tokens = np.asarray(factors, float), np.asarray(tokens, float)
    p, free = np.zeros(len(factors)), factors > 0
    if tokens[free].sum() <= budget:
        return free.astype(float)
    while free.any():
        c = (budget - tokens[p >= 1].sum()) / (factors[free] * tokens[free]).sum()
        over = free & (factors * c >= 1)
        p[free] = np.minimum(1.0, factors[free] * c)
        if not over.any():
            break
        free &= ~over
    return p


def _classes(column: str, targets: Mapping[str, float]) -> F.Column:
    named = [k for k in targets if k != OTHER]
    return F.when(F.col(column).isin(named), F.col(column)).otherwise(F.lit(OTHER))


def _plan(measured: DataFrame, dims: list[str], targets: list[Mapping[str, float]], budget_share: float) -> DataFrame:
    """One row per cell: its values, factor and probability. The targets bound the number of rows."""
    want = [shares(t) for t in targets]
    counted = measured.groupBy(*dims).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    spark = measured.sparkSession
    shape = ", ".join(f"{d} string" for d in dims) + ", weight double, probability double"
    tokens = np.array([r.tokens for r in counted], float)
    if not tokens.sum():  # nothing to weigh: documents without a word stay as they are
        return spark.createDataFrame([(*r[: len(dims)], 1.0, 1.0) for r in counted], shape)
    factors = rake([tuple(r[: len(dims)]) for r in counted], tokens, want)
    p = calibrated(factors, tokens, budget_share * tokens.sum())
    # cells without tokens cost nothing and stay
    rows = [(*r[: len(dims)], float(f), float(q)) if r.tokens else (*r[: len(dims)], 1.0, 1.0) for r, f, q in zip(counted, factors, p, strict=True)]
    return spark.createDataFrame(rows, shape)


def draw(id_column: F.Column, seed: int) -> F.Column:
    """A number in [0, 1) that only the id and the seed decide."""
    return F.shiftrightunsigned(F.xxhash64(id_column, F.lit(seed)), 11) / F.lit(float(1 << 53))


def weighed(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]],
    budget_share: float = 0.5,
    seed: int = 7,
    topics: int = TOPICS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per document: doc_id, source, lang, topic (classes), tokens, weight, probability, kept.

    ``targets``: shares for ``source``, ``lang`` and ``topic``. Null values belong to ``other``; null and empty
    texts have no tokens and stay. Rows repeated with one id are drawn alike, as are all rows with a null id.
    An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    dims = ["source", "lang", "topic"]
    slim = docs.select(
        F.col(text_col).cast("string").alias("text"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    cells = slim.mapInArrow(_measure(topics, len(dims)), "doc_id long, source string, lang string, tokens long, topic string")
    cells = stage(cells.select("doc_id", "tokens", *(_classes(d, targets[d]).alias(d) for d in dims)), "tokens")
    plan = _plan(cells, dims, [targets[d] for d in dims], budget_share)
    joined = cells.join(F.broadcast(plan), dims)  # at most the product of the numbers of targets
    kept = draw(F.col("doc_id"), seed) < F.col("probability")
    return joined.select("doc_id", *dims, "tokens", "weight", "probability", kept.alias("kept"))


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], budget_share: float = 0.5, seed: int = 7, id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows of ``docs``, all columns, that the draw takes (see :func:`weighed`)."""
    node = fresh(docs.columns, "_drawn")[0]
    out = weighed(docs, targets, budget_share, seed, id_col=id_col, **columns).where(~F.col("kept")).select(F.col("doc_id").alias(node)).distinct()
    return docs.join(out, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(node)), "left_anti")
