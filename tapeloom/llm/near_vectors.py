"""Near copies among vectors by a random-projection tree forest.

Every tree splits the unit vectors again and again along random directions at the median of the projections;
vectors near the median go to both sides (spill), so close pairs are seldom parted. A tree ends in leaves of
bounded size, inside which all cosines are computed. Many trees make up for pairs that one tree parts: their
number follows from the depth, so that a pair just at the threshold is met with a stated probability at every
size of the table. Medians come from a bounded sample of each node; every vector takes part in every tree.

A leaf gives one row per linked vector (the smallest id that its leaf links it with), never its pairs. The
union of all trees' rows gives components. Links are counted inside components, where every link lies: small
ones by one product, large ones by the angle to their centre. If that angle is at most half the threshold's
for all members, all are linked with each other and nothing needs comparing; otherwise only those ranges of
angles are compared, in blocks, for which the triangle inequality leaves the answer open.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import GOLDEN, mix, prepare, stage
from tapeloom.llm.components import components
from tapeloom.llm.grouped import dealt, gathered, runs, stacked

COSINE, LEAF, SPILL = 0.9, 1000, 0.05
#: chance to meet a pair just at the threshold, and the fewest trees
RECALL, LEAST_TREES = 0.995, 8
#: rows of a node from which its medians come, and levels that one round descends
SAMPLE, STEPS = 4096, 5
#: ranges of the angle to a centre, to the threshold's angle
RANGES = 32
#: moves projections apart that are equal
JITTER = 1e-9
OUT_ROWS = 20_000


def _units(batches):
    """id and the vector over its length in double precision; null for vectors that take no part."""
    for batch in batches:
        lists = batch.column(1)
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(float)
        ends, out = np.cumsum(size), np.full(len(flat), np.nan)
        good = size > 0
        for dim in np.unique(size[good]).tolist():
            at = np.flatnonzero(size == dim)
            place = (ends[at] - dim)[:, None] + np.arange(dim)
            x = flat[place]
            with np.errstate(invalid="ignore", divide="ignore"):
                most = np.abs(x).max(axis=1, keepdims=True)
                # scaled first, so squares neither overflow nor vanish
                x = x / most
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            good[at] = np.isfinite(most[:, 0]) & (most[:, 0] > 0) & np.isfinite(x).all(axis=1)
            out[place] = x + 0.0
        good &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        kept = pa.array(out[np.repeat(good, size)])
        offsets = pa.array(np.r_[0, np.cumsum(np.where(good, size, 0))].astype(np.int32))
        vectors = pa.ListArray.from_arrays(offsets, kept, mask=pa.array(~good))
        yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["id", "v"])


def directions(tree: int, dim: int, levels: int) -> np.ndarray:
    """Random directions of a tree's levels, the same in every task."""
    return np.random.default_rng([tree, dim, levels]).standard_normal((dim, levels)) / math.sqrt(max(dim, 1))


def levels_for(rows: int, leaf: int, spill: float) -> int:
    return max(1, math.ceil(math.log(max(rows, 1) / leaf) / -math.log(0.5 + spill))) if rows > leaf else 1


def trees_for(rows: int, leaf: int, spill: float, cosine: float, recall: float) -> int:
    """Trees that meet a pair at the threshold with probability ``recall``, vectors being spread evenly.

    A split parts a pair if the gap of its projections reaches over the spilled range around the median.
    """
    normal, chord = NormalDist(), math.sqrt(max(2 - 2 * cosine, 1e-12))
    wide = 2 * normal.inv_cdf(0.5 + spill) / chord
    parted = chord * 2 * (normal.pdf(wide) - wide * (1 - normal.cdf(wide))) * normal.pdf(0)
    depth = levels_for(rows, leaf, spill) if rows > leaf else 0
    together = (1 - parted) ** depth
    return LEAST_TREES if together > 1 - 1e-12 else max(LEAST_TREES, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def _projected(trees: int, levels: int):
    def run(batches):
        for batch in batches:
            keys, dims = batch.column("key").to_numpy(), batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                x, own_keys = stacked(own.column("v")), keys[dims == dim]
                for tree in range(trees):
                    p = x @ directions(tree, dim, levels)
                    salt = mix(own_keys.view(np.uint64)[:, None] ^ mix(np.arange(levels, dtype=np.uint64) + np.uint64(tree * 1_000_003 + 7)))
                    p = p + JITTER * (salt >> np.uint64(11)).astype(float) / 2.0**53
                    root = np.full(len(own_keys), mix(np.array([tree * 65_537 + dim], np.uint64) * np.uint64(GOLDEN))[0])
                    at = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), levels).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(root.view(np.int64)), pa.array(np.zeros(len(own_keys), np.int32)), pa.array(own_keys), at], names=["node", "depth", "key", "p"])

    return run


def _splits(spill: float):
    """Heaps of (low, high) borders of the spilled ranges of one node and the nodes below it."""
    shape = pa.schema([("node", pa.int64()), ("steps", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])

    def fit(table: pa.Table):
        p, steps, depth = stacked(table.column("p")), table.column("steps")[0].as_py(), table.column("depth")[0].as_py()
        low, high, rows = np.zeros(2**steps - 1), np.zeros(2**steps - 1), {0: np.arange(len(p))}
        for h in range(2**steps - 1):
            own = rows.pop(h)
            x = p[own, (depth + int(math.log2(h + 1))) % p.shape[1]]
            if len(x):
                low[h], high[h] = np.quantile(x, [0.5 - spill, 0.5 + spill], method="nearest")
            if 2 * h + 2 < 2**steps - 1:
                rows[2 * h + 1], rows[2 * h + 2] = own[x <= high[h]], own[x >= low[h]]
        return pa.Table.from_pylist([{"node": table.column("node")[0].as_py(), "steps": steps, "low": low.tolist(), "high": high.tolist()}], shape)

    return lambda batches: gathered(map(fit, runs(batches, "node")), 200, shape)


def _descend(batches):
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        steps = np.nan_to_num(batch.column("steps").to_numpy(zero_copy_only=False).astype(float)).astype(int)
        node, depth, p = batch.column("node").to_numpy(), batch.column("depth").to_numpy(), stacked(batch.column("p"))
        wide = 2 ** int(steps.max()) - 1
        low, high = np.zeros((n, max(wide, 1))), np.zeros((n, max(wide, 1)))
        for own, column in ((low, "low"), (high, "high")):
            for i, values in zip(np.flatnonzero(steps), batch.column(column).filter(pa.array(steps > 0)).to_numpy(zero_copy_only=False), strict=True):
                own[i, : len(values)] = values
        row, heap = np.arange(n), np.zeros(n, int)
        for level in range(int(steps.max())):
            going = steps[row] > level
            x, at = p[row, (depth[row] + level) % p.shape[1]], np.minimum(heap, wide - 1)
            left, right = going & (x <= high[row, at]), going & (x >= low[row, at])
            still = ~going
            row, heap = np.r_[row[still], row[left], row[right]], np.r_[heap[still], 2 * heap[left] + 1, 2 * heap[right] + 2]
        down = mix(node[row].view(np.uint64) ^ mix(heap.astype(np.uint64) * np.uint64(GOLDEN)))
        new = np.where(steps[row] > 0, down, node[row].view(np.uint64)).view(np.int64)
        cols = [pa.array(new), pa.array((depth[row] + steps[row]).astype(np.int32)), batch.column("key").take(pa.array(row)), batch.column("p").take(pa.array(row))]
        yield pa.RecordBatch.from_arrays(cols, names=["node", "depth", "key", "p"])


def leaves(reps: DataFrame, trees: int, levels: int, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> DataFrame:
    """node, key: the leaves of all trees; no leaf has more than ``leaf`` rows. ``reps``: key, dim, v (unit vectors)."""
    at = stage(reps.select("key", "dim", "v").mapInArrow(_projected(trees, levels), "node long, depth int, key long, p array<double>"), "nodes")
    while True:
        sizes = at.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf)
        steps = F.least(F.lit(STEPS), F.ceil(F.log(F.col("n") / leaf) / -math.log(0.5 + spill))).cast("int")
        large = stage(sizes.select("node", "n", F.greatest(steps, F.lit(1)).alias("steps")), "large")
        if large.isEmpty():
            return at.select("node", "key")
        # a hash of row and node draws about ``sample`` rows of each large node
        drawn = F.pmod(F.xxhash64("key", "node"), F.lit(1 << 40)) < (F.lit(float(sample) * (1 << 40)) / F.col("n"))
        some = at.join(large, "node").where(drawn).select("node", "depth", "p", "steps")
        splits = dealt(some, "node").mapInArrow(_splits(spill), "node long, steps int, low array<double>, high array<double>")
        at = stage(at.join(stage(splits, "splits"), "node", "left").mapInArrow(_descend, "node long, depth int, key long, p array<double>"), "nodes")


def _labels(near: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric relation, as the smallest position."""
    label = np.arange(len(near))
    some = np.flatnonzero(near.sum(axis=1) > 1)
    inner, own = near[np.ix_(some, some)], some.copy()
    while len(own):
        low = np.where(inner, own[None, :], len(near)).min(axis=1)
        # a label is a position, and that position's label may be lower still
        low = low[np.searchsorted(some, low)]
        if (low == own).all():
            break
        own = low
    label[some] = own
    return label


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(cosine: float):
    def leaf(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        rid, dims, out = table.column("rid").to_numpy(), table.column("dim").to_numpy(), []
        for dim in np.unique(dims).tolist():
            own = dims == dim
            x = stacked(table.column("v").filter(pa.array(own)))
            label = _labels(x @ x.T >= cosine)
            moved = label != np.arange(len(label))
            out.append((rid[own][moved], rid[own][label[moved]]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=EDGE)

    return lambda batches: gathered((leaf(t) for t in runs(batches, "node")), OUT_ROWS, EDGE)


COUNT = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("n", pa.int64())])


def _counted(cosine: float, group: str):
    """Weighted links of each row of a group; with a column ``side``, only those between rows of unlike sides."""

    def count(table: pa.Table) -> pa.Table:
        dims, w = table.column("dim").to_numpy(), table.column("w").to_numpy()
        side = table.column("side").to_numpy() if "side" in table.column_names else None
        n = np.zeros(len(w), np.int64)
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            x = stacked(table.column("v").take(pa.array(own)))
            if side is None or not side[own].any():
                near = x @ x.T >= cosine
                np.fill_diagonal(near, False)
                n[own] = near @ w[own]
            else:
                a, b = own[side[own] == 0], own[side[own] == 1]
                near = x[side[own] == 0] @ x[side[own] == 1].T >= cosine
                n[a], n[b] = near @ w[b], near.T @ w[a]
        return pa.Table.from_arrays([table.column("key"), table.column("key2"), pa.chunked_array([n])], schema=COUNT)

    return lambda batches: gathered((count(t) for t in runs(batches, group)), OUT_ROWS, COUNT)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)


def _large_counts(members: DataFrame, cosine: float, leaf: int) -> DataFrame:
    """key, key2, n of components with more than ``leaf`` rows."""
    reach = math.acos(cosine)
    parts = members.select("component", F.posexplode("v")).groupBy("component", "pos").agg(F.sum("col").alias("s"))
    centres = parts.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda e: e.s).alias("c"))
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, e: a + e * e))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot("v", "c") / length)))
    # a sum of zero is no centre: then every vector counts as half a turn away
    seen = stage(members.join(centres, "component").withColumn("angle", F.when(length > 1e-9, angle).otherwise(F.lit(math.pi))).drop("c"), "angles")
    step = reach / RANGES
    bins = seen.withColumn("bin", F.floor(F.col("angle") / step).cast("int"))
    ranges = stage(bins.groupBy("component", "bin").agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("weight")), "ranges")
    other = ranges.select(F.col("component").alias("oc"), F.col("bin").alias("ob"), F.col("rows").alias("orows"), F.col("weight").alias("ow"))
    meets = ranges.join(other, F.col("component") == F.col("oc"))
    # both angles together within reach: linked for sure; a gap beyond reach: never; the rounding of a cosine is left open
    sure = F.col("bin") + F.col("ob") + 2 < RANGES
    certain = meets.where(sure).groupBy("component", "bin").agg(F.sum("ow").alias("sure"))
    base = bins.join(certain, ["component", "bin"], "left")
    own = F.when(2 * F.col("bin") + 2 < RANGES, F.col("w")).otherwise(0)
    base = base.select("key", "key2", (F.coalesce("sure", F.lit(0)) - own).alias("n"))
    chunks = F.ceil(F.col("rows") / leaf).cast("int")
    unsure = meets.where(~sure & (F.abs(F.col("bin") - F.col("ob")) <= RANGES + 1) & (F.col("bin") <= F.col("ob")))
    unsure = unsure.select("component", "bin", "ob", chunks.alias("na"), F.ceil(F.col("orows") / leaf).cast("int").alias("nb"))
    both = unsure.select("component", F.col("bin").alias("mine"), "bin", "ob", "na", "nb", F.lit(0).alias("side")).unionByName(
        unsure.where("bin <> ob").select("component", F.col("ob").alias("mine"), "bin", "ob", "na", "nb", F.lit(1).alias("side"))
    )
    placed = bins.withColumnRenamed("bin", "mine").join(both, ["component", "mine"])
    cut = F.pmod(F.xxhash64("key", "key2"), F.when(F.col("side") == 0, F.col("na")).otherwise(F.col("nb"))).cast("int")
    # a range meets itself in pairs of chunks, first chunk <= second; two ranges meet in all pairs of their chunks
    mine = F.expr(
        "CASE WHEN bin = ob THEN transform(sequence(0, na - 1), o -> struct(least(cut, o) AS a, greatest(cut, o) AS b, int(cut > o) AS s)) "
        "WHEN side = 0 THEN transform(sequence(0, nb - 1), o -> struct(cut AS a, o AS b, 0 AS s)) "
        "ELSE transform(sequence(0, na - 1), o -> struct(o AS a, cut AS b, 1 AS s)) END"
    )
    rows = placed.withColumn("cut", cut).select("*", F.explode(mine).alias("m"))
    block = F.concat_ws(":", "component", "bin", "ob", "m.a", "m.b").alias("block")
    rows = rows.select(block, "key", "key2", "dim", "w", "v", F.col("m.s").cast("int").alias("side"))
    compared = dealt(rows, "block").mapInArrow(_counted(cosine, "block"), "key long, key2 long, n long")
    return base.unionByName(compared).groupBy("key", "key2").agg(F.sum("n").alias("n"))


def link(
    embeddings: DataFrame,
    cosine: float = COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    leaf: int = LEAF,
    spill: float = SPILL,
    trees: int | None = None,
) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    Two vectors link when their cosine is at least ``cosine``; pairs of unlike dimension never do. ``n_links``
    counts the other rows linked directly, equal vectors among them; ``component_id`` is the smallest id
    reachable; ``kept`` tells the row whose id that is. Vectors that are null, empty, zero or hold a null or a
    non-finite component link with nothing, nor do rows with a null id (their component is null and they stay).
    Rows that share an id are one node of the components with several vectors. An empty table gives no rows.
    Extra columns are not read. All links are exact; links that no tree meets are missing (see ``RECALL``), but
    inside a component every link counts.
    """
    spark = prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.mapInArrow(_units, "id long, v array<double>")
    rows = stage(rows.select("id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("key"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v")).alias("key2")), "vectors")
    # equal vectors become one row with a weight; two 64-bit hashes stand for the components
    equal = rows.where("v is not null").groupBy("key", "key2").agg(F.min("id").alias("rid"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    reps = stage(equal.select("key", "key2", "rid", "w", F.size("v").alias("dim"), "v"), "unlike")
    n = reps.count()
    levels = levels_for(n, leaf, spill)
    ends = leaves(reps, trees or trees_for(n, leaf, spill, cosine, RECALL), levels, leaf, spill)
    filled = ends.join(reps.select("key", "rid", "dim", "v"), "key").drop("key")
    edges = dealt(filled, "node").mapInArrow(_linked(cosine), "a long, b long").distinct()
    # an id of several rows holds their vectors together
    twice = rows.where("v is not null").groupBy("id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    tied = rows.select("id", "key", "key2").join(twice, "id", "left_semi").join(reps, ["key", "key2"]).where("id <> rid")
    found = components(edges.unionByName(tied.select(F.col("id").alias("a"), F.col("rid").alias("b"))))

    # members of components of several unlike vectors; all links lie inside components
    members = reps.join(found, F.col("rid") == F.col("node")).drop("node")
    # a component's smallest node is listed by no edge of its own
    heads = reps.join(found.select("component").distinct(), F.col("rid") == F.col("component"))
    members = stage(members.unionByName(heads), "members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = members.join(sizes, "component")
    small = dealt(members.where(F.col("size") <= leaf).select("component", "key", "key2", "dim", "w", "v"), "component")
    counts = small.mapInArrow(_counted(cosine, "component"), "key long, key2 long, n long")
    if not sizes.where(F.col("size") > leaf).isEmpty():
        counts = counts.unionByName(_large_counts(members.where(F.col("size") > leaf), cosine, leaf))
    per_vector = reps.select("key", "key2", "w").join(counts, ["key", "key2"], "left")
    per_vector = per_vector.select("key", "key2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    # a row's own id may be larger than that of its equal vectors
    class_of = reps.select("key", "key2", "rid").join(found.select("node", "component"), F.col("rid") == F.col("node"), "left")
    class_of = class_of.select("key", "key2", F.coalesce("component", "rid").alias("component_id"))
    joined = rows.select("id", "key", "key2").join(per_vector.join(class_of, ["key", "key2"]), ["key", "key2"], "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast(T.LongType()).alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
