"""Divergence of each source's vocabulary from the other sources of its language, and the terms that set it apart.

Terms are counted by Arrow kernels inside the input tasks (lower-casing, regular-expression split, dictionary
codes, hash grouping), so only one row per (language, source, term) and task crosses the shuffle. Terms kept by a
language are dealt by hash into shards; a shard turns its counts into a matrix of terms x sources and adds up
the divergences of all pairs of columns. Everything is integer arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.common import prepare, stage

#: what stands between terms, in bytes: all ASCII but letters
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, TOP_TERMS = 10, 10
UNIT = 10**9
#: distinct (language, source, term) rows that a task holds before it writes them out
HELD_ROWS = 400_000
#: texts are counted in slices of so many bytes
SLICE_BYTES = 8 << 20
#: (source, term) rows of one shard, about
SHARD_ROWS = 100_000

PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
KEYS = ["lang", "source", "term"]


def _slices(batch: pa.RecordBatch):
    """Parts of a batch with texts of about ``SLICE_BYTES`` together; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """n and docs per (lang, source, term) of some documents."""
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), BETWEEN)
    codes = pc.list_flatten(lists).dictionary_encode()
    pairs = pa.table({"doc": pc.list_parent_indices(lists), "code": codes.indices})
    per_doc = pairs.group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    doc = per_doc.column("doc")
    wide = pa.table({"lang": batch.column("lang").take(doc), "source": batch.column("source").take(doc), "code": per_doc.column("code"), "k": per_doc.column("count_all")})
    wide = wide.set_column(0, "lang", wide.column("lang").dictionary_encode()).set_column(1, "source", wide.column("source").dictionary_encode())
    sums = wide.unify_dictionaries().group_by(["lang", "source", "code"], use_threads=False).aggregate([("k", "sum"), ([], "count_all")])
    cols = [sums.column("lang").cast(pa.string()), sums.column("source").cast(pa.string()), codes.dictionary.take(sums.column("code")), sums.column("k_sum"), sums.column("count_all")]
    out = pa.Table.from_arrays(cols, schema=PARTIAL)
    return out.filter(pc.not_equal(out.column("term"), ""))


def _merged(parts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(parts).group_by(KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.Table.from_arrays([sums.column(c) for c in (*KEYS, "n_sum", "docs_sum")], schema=PARTIAL)


def _partials(batches):
    held: list[pa.Table] = []
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in batch.columns], names=batch.schema.names)
        for part in _slices(batch):
            held.append(_counted(part))
        if sum(t.num_rows for t in held) > HELD_ROWS:
            held = [_merged(held)]
            if held[0].num_rows > HELD_ROWS // 2:
                yield from held[0].combine_chunks().to_batches()
                held = []
    if held:
        yield from _merged(held).combine_chunks().to_batches()


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * count / total)`` for ``count <= total < 2**53``, by long division to stay in 64 bits."""
    quotient, rest = np.divmod(count, total)
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, total)
        quotient = quotient * 1000 + part
    return 1 + quotient


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


SHARD = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _shard(left: pa.Table, right: pa.Table) -> pa.Table:
    """Divergences of one shard. left: source, term, n, kept; right: the language's sources with their totals."""
    if not left.num_rows or not right.num_rows:
        return SHARD.empty_table()
    lang, kept, whole = right.column("lang")[0].as_py(), right.column("kept")[0].as_py(), right.column("whole")[0].as_py()
    right = right.sort_by("source")
    sources = right.column("source").combine_chunks()
    terms = left.column("term").combine_chunks().dictionary_encode()
    col = pc.index_in(left.column("source"), sources).to_numpy()
    counts = np.zeros((len(terms.dictionary), len(sources)), np.int64)
    counts[terms.indices.to_numpy(), col] = left.column("n").to_numpy()
    totals = right.column("total").to_numpy() + 2 * kept
    p = scaled(counts + 2, totals[None, :])
    q = scaled(counts.sum(axis=1) + 2, np.int64(whole + 2 * kept))
    names, out = sources.to_pylist(), []
    sums = np.array([distance(p, p[:, [i]]).sum(axis=0) for i in range(len(names))])
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    out.append(pa.Table.from_arrays([pa.array([lang] * len(a), pa.string()), sources.take(pa.array(a)), pa.array(["pair"] * len(a), pa.string()), sources.take(pa.array(b)), pa.array(sums[a, b])], schema=SHARD))
    t, s = np.nonzero((counts > 0) & (p > q[:, None]))
    value = distance(p, q[:, None])[t, s]
    out.append(pa.Table.from_arrays([pa.array([lang] * len(t), pa.string()), sources.take(pa.array(s)), pa.array(["term"] * len(t), pa.string()), terms.dictionary.take(pa.array(t)), pa.array(value)], schema=SHARD))
    return pa.concat_tables(out)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank for every occurring (lang, source) group.

    Terms are runs of ASCII letters and of all characters outside ASCII, A-Z lower-cased; a language keeps those
    in at least ``least_docs`` of its documents. With count occurrences of a kept term in a group or language,
    N all its occurrences of kept terms and V kept terms, ``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))``.
    Two values are ``floor((p - q)**2 / (p + q))`` apart. Part ``pair``: each other source of the language, with
    the sum over all kept terms (0 without any). Part ``term``: the ``top_terms`` kept terms of the group that
    are furthest above their language. Ranks start at 1, by value downwards, ties by name in byte order.
    Null text, lang and source count as ''; repeated rows count repeatedly; an empty table gives no rows; extra
    columns are not read.
    """
    spark = prepare(docs.sparkSession)
    of = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    slim = docs.select(of(lang_col, "lang"), of(source_col, "source"), of(text_col, "text"))
    shape = "lang string, source string, term string, n long, docs long"
    merged = slim.mapInArrow(_partials, shape).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    merged = stage(merged, "terms")
    kept = merged.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
    used = stage(merged.drop("docs").join(kept, ["lang", "term"]), "kept")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    wholes = used.groupBy("lang").agg(F.sum("n").alias("whole")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang")
    groups = stage(slim.select("lang", "source").distinct(), "groups")
    facts = groups.join(totals, ["lang", "source"], "left").join(wholes, "lang")
    facts = stage(facts.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "whole", "kept"), "totals")
    shards = max(1, -(-used.count() // SHARD_ROWS))
    dealt = used.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
    of_shard = facts.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["lang", "shard"]
    found = dealt.groupBy(*keys).cogroup(of_shard.groupBy(*keys)).applyInArrow(_shard, "lang string, source string, part string, item string, value long")
    found = stage(found, "shards")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    first = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return ranked.unionByName(first).select("lang", "source", "part", "item", "value", "rank")
