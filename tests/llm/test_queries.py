"""The corpus queries on the smallest tables: against their SQL where they have one."""

import os

import oracle
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tapeloom.catalog.base import Query
from tapeloom.llm.queries import QUERIES, SQL

SF = os.environ.get("TAPELOOM_CORPUS_SF", f"{oracle.TESTDATA}/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, con, key):
    ok, msg, _ = oracle.compare(spark, con, key, Query(QUERIES[key], SQL[key]), SF)
    print(msg)
    assert ok, msg


def test_contract():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_stages(spark):
    """Each stage works on what the one before kept, and all but the last keep the columns of documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, SF), name)
        assert docs.columns == columns
        got = docs.collect()
        assert all(r.asDict() == rows[r.doc_id] for r in got) and len({r.doc_id for r in got}) == len(got)
        now = {r.doc_id for r in got}
        assert now < left
        left = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0 and out.count() > 50


def test_pipeline_stages_delete_nothing(spark):
    """A stage's rows can still be read after another stage has been called."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    steps = dict(corpus_pipeline.STAGES)
    first, second = (steps["exact_dedup"](spark, docs, SF) for _ in range(2))
    assert first.count() == second.count() > 0
    out = corpus_pipeline.run(spark, SF)
    corpus_pipeline.run(spark, SF)
    assert out.count() > 50
