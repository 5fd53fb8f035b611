"""Document quality by a regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text are brought to comparable, bounded scales (logarithms of sizes, square roots of
shares). Each class has a mean and a covariance; the covariance is shrunk towards the pooled one and that
towards a multiple of the identity. The score follows from the difference of the two log densities, i.e. of
Mahalanobis distances through the cached inverse Cholesky factors. Class sums are formed inside the tasks and
added up by Spark, so fitting uses every labelled row and brings a few hundred numbers to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import WORD, fresh, prepare, stage

SYMBOLS = "#$%&*|@^~<>{}[]\\=+_/`"
STATISTICS = (
    "log words, log mean word length, sqrt symbol share, sqrt capital share, sqrt digit share, sqrt end mark share, "
    "vocabulary growth, sqrt share of the commonest word, log mean line words, sqrt repeated line share, "
    "sqrt share of lines without end mark, sqrt share of words without letter, sqrt share of words ending in a symbol, "
    "sqrt exclamation share, log longest word"
).split(", ")
#: weight of the pooled covariance in a class covariance, and of the identity in the pooled one
TO_POOLED, TO_IDENTITY = 0.3, 0.02
#: rows added to each class so that a prior never vanishes
PRIOR_ROWS = 1.0


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; an empty or null text has zeros."""
    words = WORD.findall(text) if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars = len(words), sum(map(len, words))
    letters = Counter(text)
    symbols = sum(letters[c] for c in SYMBOLS)
    digits = sum(letters[c] for c in "0123456789")
    upper = sum(v for c, v in letters.items() if c.isupper())
    alpha = sum(v for c, v in letters.items() if c.isalpha())
    ends = letters["."] + letters["?"] + letters["!"]
    kinds = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    plain = sum(v for w, v in kinds.items() if not any(map(str.isalpha, w)))
    tails = sum(v for w, v in kinds.items() if w[-1] in SYMBOLS)
    share = lambda a, b: math.sqrt(a / b) if b else 0.0
    return [
        math.log1p(n),
        math.log(chars / n),
        share(symbols, chars),
        share(upper, alpha),
        share(digits, chars),
        share(ends, n + ends),
        math.log1p(len(kinds)) / math.log1p(n),
        share(max(kinds.values()), n),
        math.log1p(n / max(1, len(lines))),
        share(len(lines) - len(set(lines)), len(lines)),
        share(sum(line.rstrip()[-1] not in ".!?:;\"'" for line in lines), len(lines)),
        share(plain, n),
        share(tails, n),
        share(letters["!"], chars),
        math.log1p(max(map(len, kinds))),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log offsets; index 1 is the good class."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        # divided by the number of statistics: the order and the side of 0.5 stay, the scores spread out
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / x.shape[1], -700, 700)))


def fitted(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant | None:
    """From rows, sums and sums of outer products per class; None where a class has no row."""
    if min(counts) < 1:
        return None
    k = sums.shape[1]
    means = sums / counts[:, None]
    scatter = squares - counts[:, None, None] * np.einsum("ci,cj->cij", means, means)
    pooled = scatter.sum(axis=0) / counts.sum()
    # statistics that never vary get a unit scale
    scale = np.sqrt(np.where(np.diag(pooled) > 1e-12, np.diag(pooled), 1.0))
    pooled = (1 - TO_IDENTITY) * pooled + TO_IDENTITY * np.diag(scale**2)
    factors, offsets = [], []
    for c in (0, 1):
        weight = TO_POOLED + (1 - TO_POOLED) * k / (k + counts[c])
        shrunk = (1 - weight) * scatter[c] / counts[c] + weight * pooled
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        offsets.append(math.log((counts[c] + PRIOR_ROWS) / (counts.sum() + 2 * PRIOR_ROWS)) - np.log(np.diag(lower)).sum())
    return Discriminant(means, np.array(factors), np.array(offsets))


def _measure(batches):
    kind = pa.list_(pa.float64())
    for batch in batches:
        x = [statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, kind)], names=["doc_id", "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_measure, "doc_id long, x array<double>")


def held_out(doc_id) -> F.Column:
    """Rows that never take part in fitting: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sums(batches):
    k = len(STATISTICS)
    total = np.zeros((2, 1 + k + k * k))
    for batch in batches:
        x = np.array(batch.column(1).to_pylist(), float).reshape(-1, k)
        y = batch.column(0).to_numpy(zero_copy_only=False)
        for c in (0, 1):
            own = x[y == c]
            total[c] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["class", "sums"]
    )


def fit(features: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Discriminant | None:
    """Fit on all labelled rows outside the held-out third. Null labels and labels other than 0 and 1 don't count."""
    k = len(STATISTICS)
    marks = labels.select(F.col(id_col).cast("long").alias("marked"), F.col(label_col).cast("int").alias("class"))
    train = features.join(marks.where("class in (0, 1)"), F.col("doc_id") == F.col("marked")).where(~held_out(F.col("doc_id")))
    parts = train.select("class", "x").mapInArrow(_sums, "class int, sums array<double>")
    rows = parts.select("class", F.posexplode("sums").alias("at", "v")).groupBy("class", "at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + k + k * k))
    for c, at, v in rows:
        total[c, at] = v
    return fitted(total[:, 0], total[:, 1 : 1 + k], total[:, 1 + k :].reshape(2, k, k))


def _scores(model: Discriminant | None, x: list) -> np.ndarray:
    x = np.array(x, float).reshape(-1, len(STATISTICS))
    return np.full(len(x), 0.5) if model is None else model.score(x)


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels, language, source and id are no inputs of a score. Null texts count as empty, and empty texts are
    scored like all others. Rows repeated with one id get a row each; a null id is never held out. Without a
    labelled row of both classes every score is 0.5. An empty table gives an empty result.
    """
    features = stage(measured(docs, id_col, text_col), "statistics")
    model = fit(features, labels, label_col)

    def run(batches):
        for batch in batches:
            s = _scores(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = features.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject."""
    model = fit(measured(docs, id_col, text_col), labels, label_col)
    name = fresh(docs.columns, "_predicted")[0]

    @F.pandas_udf("int")
    def predicted(texts):
        import pandas as pd

        return pd.Series((_scores(model, [statistics(t) for t in texts]) >= 0.5).astype("int32"))

    return docs.withColumn(name, predicted(F.col(f"`{text_col}`").cast("string"))).where(F.col(name) == 1).drop(name)
