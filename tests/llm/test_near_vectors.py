import math
import random

import numpy as np
import pytest

from tapeloom.llm import near_vectors as nv

ROW = "vec_id long, embedding array<float>, key string, n_links int"


def brute(rows, cosine=0.9):
    """vec_id and embedding pairs -> sorted (vec_id, n_links, component, kept), ids being unique."""
    good = []
    for i, v, *_ in rows:
        x = None if v is None else np.array([math.nan if e is None else np.float32(e) for e in v], float)
        if i is not None and x is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            good.append((i, x / np.abs(x).max()))
    links = {i: set() for i, *_ in rows}
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = None if i is None else min(seen)
        out.append((i, len(links[i]), low, i == low))
    return sorted(out, key=str)


def result(spark, rows, parts=4, **args):
    df = spark.createDataFrame([(i, v, "k", 1) for i, v in rows], ROW).repartition(parts)
    out = nv.link(df, **args)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=str)


def at_cosine(rng, x, cosine):
    y = rng.normal(size=len(x))
    y -= (y @ x) / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def clustered(n=500, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(n)]
    for i in range(0, n, 5):
        out.append(at_cosine(rng, out[i], rng.choice([0.91, 0.95, 0.99])) * rng.choice([0.01, 1, 30]))
    return [(i, list(map(float, v))) for i, v in enumerate(out)]


@pytest.mark.parametrize("leaf", [40, 2000])
def test_equals_brute_force(spark, leaf):
    rows = clustered(300, 12)
    near = [list(map(float, np.array(rows[0][1]) + 0.01 * i)) for i in range(30)]
    rows += [(1000 + i, v) for i, v in enumerate(near)] + [(1100 + i, rows[7][1]) for i in range(25)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [1.0, None] + [0.0] * 10), (2004, [float("nan")] * 12)]
    rows += [(2005, [float("inf")] + [0.0] * 11), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [1e-30] * 12), (2009, [1e30] * 12)]
    assert result(spark, rows, leaf=leaf, trees=24) == brute(rows)


def test_hot_groups_are_counted_without_pairs(spark):
    """A tight group far larger than a leaf, a wide one whose members don't all link, and one of equal vectors."""
    rng = np.random.default_rng(1)
    base, other = rng.normal(size=16), rng.normal(size=16)
    tight = [base / np.linalg.norm(base) + rng.normal(size=16) * 0.01 for _ in range(300)]
    wide = [other / np.linalg.norm(other) + rng.normal(size=16) * 0.07 for _ in range(260)]
    rows = [(i, list(map(float, v))) for i, v in enumerate(tight + wide + [tight[3]] * 200)]
    random.Random(3).shuffle(rows)
    want = brute(rows)
    assert len({r[1] for r in want}) > 20
    assert result(spark, rows, leaf=60, trees=12) == want


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs just over the threshold, in small leaves: the number of trees follows from the depth."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1500):
        x = rng.normal(size=64)
        rows += [(2 * i, list(map(float, x))), (2 * i + 1, list(map(float, at_cosine(rng, x, 0.901))))]
    got = result(spark, rows, leaf=50)
    assert sum(r[1] for r in got) >= 0.99 * 3000 and all(r[1] <= 1 for r in got)


def test_leaves_are_bounded_and_hold_all(spark):
    df = spark.createDataFrame([(i, 8, list(map(float, np.random.default_rng(i % 3).normal(size=8)))) for i in range(900)], "key long, dim int, v array<double>")
    sizes = nv.leaves(df, 3, 4, leaf=100).groupBy("node").count().collect()
    assert max(r["count"] for r in sizes) <= 100
    assert nv.leaves(df, 3, 4, leaf=100).select("key").distinct().count() == 900


def test_trees_follow_the_depth():
    assert nv.trees_for(900, 1000, 0.05, 0.9, 0.995) == nv.LEAST_TREES
    assert 8 < nv.trees_for(10**9, 1000, 0.05, 0.9, 0.995) < 60


def test_repeated_ids_and_none(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.1, 1.0]), (3, [1.0, 0.1]), (None, [1.0, 0.0]), (5, [-1.0, 0.0])]
    got = result(spark, rows)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 0, None, True), (5, 0, 5, True)], key=str)
    assert result(spark, []) == []
