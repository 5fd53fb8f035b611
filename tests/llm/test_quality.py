import random
import zlib

import numpy as np

from tapeloom.llm import quality

DOCS = "doc_id long, text string, score string, x int"


def make(n=600, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        body = rng.choices(words, k=rng.randrange(20, 200))
        good = rng.random() < 0.75
        if not good:
            body = [w + rng.choice(["$$$", "###"]) for w in body] if rng.random() < 0.5 else [w.upper() + "!!" for w in body]
        docs.append((i, " ".join(body).capitalize() + ".", "s", 1))
        if i % 3:
            labels.append((i, int(good), 0, "extra"))
    return docs, labels


def test_scores(spark):
    docs, labels = make()
    odd = [(5000, None, "", 0), (5001, "", "", 0), (None, "plain words here.", "", 0), (7, docs[7][1], "", 0), (5002, "word " * 60_000, "", 0)]
    d = spark.createDataFrame(docs + odd, DOCS).repartition(4)
    la = spark.createDataFrame(labels + [(3, None, 0, ""), (None, 1, 0, ""), (4, 9, 0, "")], "doc_id long, quality int, toxic int, text string")
    got = quality.score(d, la).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {i: q for i, q, *_ in labels}
    test = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(test) > 60 and sum(a == b for a, b in test) / len(test) > 0.95
    kept = quality.keep_good(d, la)
    assert kept.columns == d.columns
    assert sorted(r[0] or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in got if r.predicted)


def test_model_equals_brute_force(spark):
    docs, labels = make(200)
    d, la = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, t string")
    model = quality.fit(quality.measured(d), la)
    use = [(i, q) for i, q, *_ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    x = np.array([quality.statistics(docs[i][1]) for i, _ in use])
    y = np.array([q for _, q in use])
    assert np.allclose(model.means[1], x[y == 1].mean(axis=0))
    pooled = sum((y == c).sum() * np.cov(x[y == c].T, bias=True) for c in (0, 1)) / len(y)
    pooled = 0.98 * pooled + 0.02 * np.diag(np.where(np.diag(pooled) > 1e-12, np.diag(pooled), 1))
    logs = []
    for c in (0, 1):
        n, k = (y == c).sum(), x.shape[1]
        w = 0.3 + 0.7 * k / (k + n)
        s = (1 - w) * np.cov(x[y == c].T, bias=True) + w * pooled
        m = x - x[y == c].mean(axis=0)
        logs.append(np.log((n + 1) / (len(y) + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", m, np.linalg.inv(s), m))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(logs[1] - logs[0]) / x.shape[1])), atol=1e-6)


def test_without_labels(spark):
    docs, labels = make(30)
    d = spark.createDataFrame(docs, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.score(d, none).collect()} == {(0.5, 1)}
    assert quality.score(d.limit(0), none).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    assert quality.keep_good(d, one).count() == 30
