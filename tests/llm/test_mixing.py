import random
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, tokens int, weight string"
TARGETS = {"source": {"a": 2, "b": 1, "other": 1}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"topic0": 1, "topic1": 1, "other": 2}}


def rows(n=3000, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(200)]
    return [
        (i, " ".join(rng.choices(words, k=rng.randrange(5, 60))), rng.choice(["en", "en", "fr"]), rng.choice("abbbbbcd"), 0, "")
        for i in range(n)
    ]


def test_margins_and_draw(spark):
    data = rows() + [(9000, None, None, None, 0, ""), (9001, "", "de", "a", 0, ""), (None, "some words of text", "en", "a", 0, ""), (5, rows(6)[5][1], "en", "b", 0, "")]
    docs = spark.createDataFrame(data, DOCS).repartition(5)
    got = mixing.weighed(docs, TARGETS, 0.3).collect()
    assert len(got) == len(data)
    topic_of = mixing.TopicOf(mixing.TOPICS)
    want = Counter((d[0], *mixing.measure(d[1], topic_of)) for d in data)
    named = {"topic0", "topic1"}
    assert Counter((r.doc_id, r.tokens, r.topic) for r in got) == Counter({}) + sum(
        (Counter({(i, n, t if t in named else "other"): c}) for (i, n, t), c in want.items()), Counter()
    )
    total = sum(r.tokens for r in got)
    for dim, wanted in TARGETS.items():
        share = Counter()
        for r in got:
            share[r[dim]] += r.weight * r.tokens / total
        norm = sum(wanted.values())
        for name, w in wanted.items():
            assert share[name] == pytest.approx(w / norm, abs=1e-6)
    assert sum(r.probability * r.tokens for r in got) == pytest.approx(0.3 * total, rel=1e-6)
    assert sum(r.tokens for r in got if r.kept) == pytest.approx(0.3 * total, rel=0.1)
    assert all(r.kept for r in got if not r.tokens)
    kept = mixing.sample(docs, TARGETS, 0.3)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_rake_against_brute_force():
    rng = np.random.default_rng(1)
    table = rng.uniform(1, 9, (3, 2, 4))
    goals = [rng.dirichlet(np.ones(n)) for n in table.shape]
    cells = [(f"a{i}", f"b{j}", f"c{k}") for i in range(3) for j in range(2) for k in range(4)]
    got = mixing.rake(cells, table.ravel(), [{f"{p}{i}": v for i, v in enumerate(g)} for p, g in zip("abc", goals, strict=True)])
    fit = table / table.sum()
    for _ in range(500):
        for axis, g in enumerate(goals):
            other = tuple(a for a in range(3) if a != axis)
            shape = [1, 1, 1]
            shape[axis] = -1
            fit = fit * (g / fit.sum(axis=other)).reshape(shape)
    assert np.allclose(got, (fit * table.sum() / table).ravel(), rtol=1e-6)


def test_calibration():
    p = mixing.calibrated(np.array([10.0, 1, 1, 0]), np.array([10.0, 50, 50, 5]), 40)
    assert p[0] == 1 and p[3] == 0 and (p * [10, 50, 50, 5]).sum() == pytest.approx(40)
    assert list(mixing.calibrated(np.array([1.0, 0]), np.array([5.0, 5]), 100)) == [1, 0]
    with pytest.raises(ValueError):
        mixing.shares({"a": -1})


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.weighed(docs, TARGETS).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 0, ""), (1, "", "en", "a", 0, "")], DOCS)
    assert mixing.sample(blank, TARGETS).count() == 2
