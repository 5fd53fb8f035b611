"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into length classes (a quarter of a power of two each), and a class into blocks of bounded
size. A bounded set of long vectors gives every query a first lower bound of its k-th score; a class whose
longest vector can't reach that bound never meets the query. Inside a block the bound becomes a local cosine
threshold: where it is high, only vectors whose leading coordinates lie in the feasible range of the query are
candidates (coordinate pruning), else those that are long enough (length pruning). Candidates are verified by
their exact integer products. Queries and vectors meet in cells of a bounded number of each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import prepare, stage

BLOCK_ROWS, QUERY_ROWS, SEEDS = 8192, 4096, 2048
#: local cosine from which the coordinates prune better than the lengths, and how many of them are looked at
COORDINATE_COSINE, FOCUS = 0.8, 3
CHUNK = 256
EXACT = 2.0**53
LOW, HIGH = -(1 << 63), (1 << 63) - 1
OUT = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def scaled(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """uid, vec_id, dim, v (integer components), norm, class; only rows with an id and finite components."""
    x = F.transform(F.col("x"), lambda e: e.cast("double"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    v = rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
    v = v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)))
    # a zero vector gets a class below all others
    cls = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 4).cast("int")).otherwise(F.lit(-1))
    return v.select("uid", "vec_id", F.size("v").alias("dim"), "v", "norm", cls.alias("cls"))


def product(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exact; in float64 where no sum can leave its exact range."""
    if not len(q) or not len(p):
        return np.zeros((len(q), len(p)))
    reach = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(p.astype(float)).max(initial=0)) * q.shape[1]
    if reach < EXACT:
        return q.astype(float) @ p.astype(float).T
    return q.astype(object) @ p.astype(object).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    order = sorted(at.tolist(), key=lambda j: (-scores[j], ids[j])) if len(at) < 1000 else at[np.lexsort((ids[at], -scores[at].astype(float)))]
    return np.array(order[:k], int)


def search_block(queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Yields (query position, vector positions, scores) of each query's best within one block, none below its bound."""
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.lexsort((ids, -norms))
    vectors, ids, norms = vectors[order], ids[order], norms[order]
    unit = vectors / np.where(norms > 0, norms, 1)[:, None]
    q_norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    top = norms[0] if len(norms) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(bounds > 0, bounds / (q_norms * top), 0.0)
    slack = 1 - 1e-9
    places: dict[int, list[int]] = {}
    own = set(query_ids.tolist())
    for j in np.flatnonzero(np.isin(ids, list(own))).tolist():
        places.setdefault(int(ids[j]), []).append(j)

    def verified(i, at, scores):
        keep = scores >= bounds[i]
        at, scores = at[keep], scores[keep]
        best = _best(scores, ids[at], k)
        return i, order[at[best]], [int(s) for s in scores[best]]

    by_length = []
    for i in range(len(queries)):
        if local[i] * slack > 1:
            continue
        if local[i] < COORDINATE_COSINE:
            by_length.append(i)
            continue
        t, mine = min(1.0, local[i] * slack), np.ones(len(ids), bool)
        direction = queries[i] / q_norms[i]
        for f in np.argsort(-np.abs(direction))[:FOCUS]:
            wide = math.sqrt(max(0.0, (1 - t * t) * (1 - direction[f] ** 2))) + 1e-9
            mine &= np.abs(unit[:, f] - direction[f] * t) <= wide + abs(direction[f]) * (1 - t)
        mine[places.get(int(query_ids[i]), [])] = False
        at = np.flatnonzero(mine)
        if len(at):
            yield verified(i, at, product(queries[i : i + 1], vectors[at])[0])
    for a in range(0, len(by_length), CHUNK):
        part = np.array(by_length[a : a + CHUNK])
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((bounds[part] > 0) & (q_norms[part] > 0), bounds[part] / q_norms[part], 0.0) * slack
        reach = np.searchsorted(-norms, -need, "right")
        scores = product(queries[part], vectors[: reach.max()])
        for row, i in enumerate(part.tolist()):
            mine = np.ones(reach[row], bool)
            mine[[j for j in places.get(int(query_ids[i]), []) if j < reach[row]]] = False
            at = np.flatnonzero(mine)
            if len(at):
                yield verified(i, at, scores[row][at])


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return OUT.empty_table()
        stack = lambda t: np.array(t.column("v").to_pylist(), np.int64).reshape(t.num_rows, -1)
        ids, query_ids, uids = (t.column(c).to_numpy() for t, c in ((left, "vec_id"), (right, "vec_id"), (right, "uid")))
        out: list[list] = [[], [], []]
        for i, at, scores in search_block(stack(right), query_ids, right.column("bound").to_numpy(), stack(left), ids, k):
            out[0] += [int(uids[i])] * len(at)
            out[1] += ids[at].tolist()
            out[2] += [max(LOW, min(HIGH, s)) for s in scores]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], schema=OUT)

    return run


def top_k(
    embeddings: DataFrame,
    every: int = 50,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each id divisible by ``every``.

    Ties go to the smaller id. Rows with a null id, a null vector or a null or non-finite component take no
    part; a query only meets vectors of its own dimension. Rows that share the query's id count as its own;
    each row with a query's id is a query. Fewer rows than ``k`` give all, an empty table gives none.
    """
    spark = prepare(embeddings.sparkSession)
    all_rows = stage(scaled(embeddings, id_col, vector_col), "vectors")
    # length classes are bounded by the exponents of a double, so this table is small
    classes = [tuple(r) for r in all_rows.groupBy("dim", "cls").agg(F.count(F.lit(1)), F.max("norm")).collect()]
    asks = all_rows.where(F.col("vec_id") % every == 0)
    groups = max(1, -(-asks.count() // query_rows))
    tops: dict[int, list[int]] = {}
    for dim, cls, n, _ in sorted(classes, key=lambda c: (-c[1], c[2])):
        if sum(x[2] for x in classes if x[0] == dim and x[1] in tops.get(dim, [])) < SEEDS:
            tops.setdefault(dim, []).append(cls)
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, own in tops.items():
        first = all_rows.where((F.col("dim") == dim) & F.col("cls").isin(own)).orderBy(F.xxhash64("uid")).limit(SEEDS)
        rows = first.select("vec_id", "v").collect()
        seeds[dim] = (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).reshape(len(rows), -1))
    plan: dict[int, list[tuple[int, float, int]]] = {}
    for dim, cls, n, high in classes:
        plan.setdefault(dim, []).append((cls, high, -(-n // block_rows)))

    def bounded(batches):
        for pdf in batches:
            found = []
            for dim, vec_id, v, norm in zip(pdf["dim"], pdf["vec_id"], pdf["v"], pdf["norm"], strict=True):
                ids, rows = seeds[dim]
                other = rows[ids != vec_id]
                scores = product(np.array([v], np.int64).reshape(1, -1), other)[0]
                bound = float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf
                # a class is needed unless its longest vector stays below the bound
                need = [(c, b) for c, high, n in plan[dim] for b in range(n) if bound <= 0 or norm * high * (1 + 1e-9) >= bound]
                found.append((bound, [{"cls": c, "block": b} for c, b in need]))
            yield pdf[["uid", "vec_id", "dim", "v"]].assign(bound=[f[0] for f in found], cells=[f[1] for f in found])

    shape = "uid long, vec_id long, dim int, v array<long>, bound double, cells array<struct<cls:int,block:int>>"
    asked = asks.select("uid", "vec_id", "dim", "v", "norm").mapInPandas(bounded, shape)
    group = F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("grp")
    asked = asked.select("uid", "vec_id", "dim", "v", "bound", F.explode("cells").alias("c"), group)
    asked = asked.select("uid", "vec_id", "dim", "v", "bound", "c.cls", "c.block", "grp")
    blocks = spark.createDataFrame([(d, c, -(-n // block_rows)) for d, c, n, _ in classes] or [(-1, 0, 1)], "bdim int, bcls int, blocks int")
    held = all_rows.join(F.broadcast(blocks), (F.col("dim") == F.col("bdim")) & (F.col("cls") == F.col("bcls")))
    held = held.select(
        "vec_id", "v", "dim", "cls", F.pmod(F.xxhash64("uid", F.lit(3)), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
    )
    keys = ["dim", "cls", "block", "grp"]
    part = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_cell(k), "uid long, vec_id long, score long")
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = asks.select(F.col("uid").alias("u"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, F.col("uid") == F.col("u")).select("query_id", "rank", "vec_id", "score")
