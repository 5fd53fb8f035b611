"""Corpus pipeline: each stage applies one of the corpus operators to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import exact_dedup, mixing, ngram_join, packing, quality
from tapeloom.llm.common import release, stage, staged, table
from tapeloom.llm.queries import MIXTURE, MIXTURE_BUDGET, TOKENIZER


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    return ngram_join.deduplicate(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by probabilities raked to the target weights."""
    return mixing.sample(docs, MIXTURE, MIXTURE_BUDGET)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("packing", pack),
]
#: trained scores and a trained tokenizer's ids have no SQL twin
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        before = set(staged())
        docs = stage(step(spark, docs, sf_dir), name)
        # the stage's rows are written: what it staged on the way goes, and so does its input
        *own, rows = [path for path in staged() if path not in before]
        release(spark, [*own, *read])
        read = [rows]
    return STAGES[-1][1](spark, docs, sf_dir)
