import math
import random
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import topk

ROW = "vec_id long, embedding array<float>, score string, norm int"


def brute(rows, every, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return Counter(out)


def rows(n=700, dim=6, seed=3):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    out = []
    for i in range(n):
        scale = rng.choice([0.01, 0.3, 1, 1, 5, 40])
        v = [x * scale + rng.gauss(0, 0.02) for x in rng.choice(base)] if rng.random() < 0.6 else [rng.gauss(0, scale) for _ in range(dim)]
        out.append((i, v, "s", 1))
    return out + [(1000 + i, base[0], "", 0) for i in range(120)]


@pytest.mark.parametrize("block,query", [(64, 7), (topk.BLOCK_ROWS, topk.QUERY_ROWS)])
def test_equals_brute_force(spark, block, query):
    data = rows() + [(2000, None, "", 0), (2050, [1.0, None] + [0.0] * 4, "", 0), (2100, [float("nan")] * 6, "", 0), (2150, [float("inf")] + [0.0] * 5, "", 0)]
    data += [(2200, [0.0] * 6, "", 0), (2250, [1.0, 2.0], "", 0), (2251, [1.0, 2.0], "", 0), (None, [1.0] * 6, "", 0), (2300, [-9.0] * 6, "", 0), (2350, [], "", 0)]
    data += [(2400, [1e6] * 6, "", 0), (50, data[50][1], "", 0), (51, data[51][1], "", 0)]
    emb = spark.createDataFrame(data, ROW).repartition(5)
    got = Counter(tuple(r) for r in topk.top_k(emb, 50, 5, block_rows=block, query_rows=query).collect())
    assert got == brute(data, 50, 5)


def test_large_components_stay_exact(spark):
    data = [(i, [2.0**40 + 2.0**20 * i, -(2.0**40)], "", 0) for i in range(60)]
    emb = spark.createDataFrame([(i, v) for i, v, *_ in data], "vec_id long, embedding array<double>")
    got = {r.score for r in topk.top_k(emb).collect()}
    assert got <= {topk.HIGH, topk.LOW}
    small = topk.product(np.array([[2**40, 1]]), np.array([[2**40, 3]]))
    assert int(small[0][0]) == 2**80 + 3


def test_few_and_none(spark):
    emb = spark.createDataFrame([(0, [1.0, 2.0], "", 0), (1, [3.0, 4.0], "", 0)], ROW)
    assert [tuple(r) for r in topk.top_k(emb).collect()] == [(0, 1, 1, 256 * 256 * 11)]
    assert topk.top_k(emb.limit(0)).count() == 0


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(2)
    center = rng.normal(size=(6, 8))
    vectors = np.floor(256 * (center[rng.integers(0, 6, 900)] + rng.normal(0, 0.05, (900, 8)))).astype(np.int64)
    queries, ids = vectors[:40], np.arange(900)
    full = queries @ vectors.T
    for i in range(40):
        full[i, i] = -(2**60)
    bounds = np.sort(full, axis=1)[:, -5].astype(float)
    got = {i: scores for i, _, scores in topk.search_block(queries, ids[:40], bounds, vectors, ids, 5)}
    assert got == {i: sorted(full[i].tolist())[-5:][::-1] for i in range(40)}
