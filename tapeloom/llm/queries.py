"""The corpus queries: each applies one operator to its whole table. SQL twins stand beside them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import divergence, exact_dedup, html_text, licenses, mixing, near_vectors, ngram_join, packing, quality, secrets, spelling, substring_dedup, topk
from tapeloom.llm.common import table

#: where the public vocabulary files are
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: shares of the mixture; the sources weigh alike, whatever they hold, and the rest of the topics share one weight
MIXTURE = {
    "source": {f"src{i}": 1.0 for i in range(20)} | {"other": 1.0},
    "lang": {"en": 0.5, "de": 0.15, "fr": 0.15, "es": 0.15, "other": 0.05},
    "topic": {f"topic{i}": 1.0 for i in range(mixing.TOPICS)} | {"other": 0.5},
}
#: share of the tokens that the mixture takes
MIXTURE_BUDGET = 0.5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(key: str, sql: str | None = None):
    def put(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return put


@add(
    "op6_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY body)
    """,
)
def op6(spark, sf_dir):
    return exact_dedup.owners(table(spark, sf_dir, "documents"))


@add(
    "op2_ngram_join",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS sh
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS cnt FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), l AS MATERIALIZED (
        SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * cnt >= 85 * (a.n + b.n - cnt)
    ), r AS (SELECT x AS node, y AS other FROM l UNION SELECT r.node, l.y FROM r JOIN l ON r.other = l.x)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(other) AS low FROM r GROUP BY node) m ON m.node = d.doc_id
    """,
)
def op2(spark, sf_dir):
    return ngram_join.label(table(spark, sf_dir, "documents"), k=4, percent=85)


@add("op8_best_fit_packing")
def op8(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


@add("op1_mixing")
def op1(spark, sf_dir):
    return mixing.weighed(table(spark, sf_dir, "documents"), MIXTURE, MIXTURE_BUDGET)


@add("op5_quality")
def op5(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@add("op3_secret_scan", secrets.sql())
def op3(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@add("op9_html_text")
def op9(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@add(
    "op7_exact_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
    """,
)
def op7(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@add("op10_substring_dedup")
def op10(spark, sf_dir):
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


@add("op4_license_scan")
def op4(spark, sf_dir):
    # the table has no paths: a document lies under its source and language, 64 ids to a folder
    folder = F.floor(F.col("doc_id") / 64).cast("string")
    path = F.concat_ws("/", "source", "lang", folder, F.col("doc_id").cast("string"))
    return licenses.scan(table(spark, sf_dir, "documents"), path)


@add(
    "op11_near_vectors",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), l AS MATERIALIZED (
        SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
        ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
    ), r AS (SELECT x AS node, y AS other FROM l UNION SELECT r.node, l.y FROM r JOIN l ON r.other = l.x),
    c AS (
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(m.low, e.vec_id)) AS component_id
        FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) n ON n.x = e.vec_id
        LEFT JOIN (SELECT node, min(other) AS low FROM r GROUP BY node) m ON m.node = e.vec_id
    )
    SELECT *, vec_id = component_id AS kept FROM c
    """,
)
def op11(spark, sf_dir):
    return near_vectors.link(table(spark, sf_dir, "embeddings"))


@add(
    "op12_source_divergence",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    ), t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY ALL),
    k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
    v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    s AS (
        SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0)::HUGEINT AS n
        FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL
    ), p AS (
        SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
        FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang
        LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
    ), x AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), u AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
    SELECT * FROM r WHERE part = 'pair' OR rank <= 10
    """,
)
def op12(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@add("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))
