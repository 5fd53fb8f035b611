"""Secret scan behind a trigram inverted index, in DataFrame operations only.

Every rule is a regular expression. From its parse tree follows a Boolean trigram query that each text with a
match satisfies: literal runs, with their alternatives, become "one of these strings", and each string means
all of its trigrams. The index holds postings (trigram, document) for the trigrams that the rules ask for;
intersecting them gives the candidates of each rule, and only those are verified with the expression itself. A
rule without a mandatory trigram scans all texts. The index is over the lower-cased text, so it serves rules
with and without regard to case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import stage

#: alternatives of a literal run up to which the run goes on
RUN = 16


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the common subset of Java and Python; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # a run that is too short for the rule has no longer match inside, so the bound may stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def _grow(runs: set[str], more: set[str]) -> set[str] | None:
    made = {a + b for a in runs for b in more}
    return made if len(made) <= RUN else None


def _strings(items) -> set[str] | None:
    """All strings that a parsed sequence stands for, or None if these are many or unbounded."""
    runs = {""}
    for kind, arg in items:
        more: set[str] | None = None
        if kind is op.LITERAL:
            more = {chr(arg)}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            more = {chr(c) for _, c in arg}
        elif kind is op.SUBPATTERN:
            more = _strings(arg[3])
        elif kind is op.BRANCH:
            each = [_strings(b) for b in arg[1]]
            more = None if None in each else set().union(*each)
        elif kind is op.MAX_REPEAT and arg[1] is not op.MAXREPEAT and arg[1] <= 2:
            one = _strings(arg[2])
            if one is not None:
                more = set()
                for times in range(arg[0], arg[1] + 1):
                    power: set[str] | None = {""}
                    for _ in range(times):
                        power = power and _grow(power, one)
                    more = None if more is None or power is None else more | power
        runs = _grow(runs, more) if more is not None else None
        if runs is None:
            return None
    return runs


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of clauses; a clause is an OR of trigram sets, each of which means all of its members. Empty: no demand."""
    clauses: list[list[frozenset[str]]] = []

    def close(runs: set[str]) -> None:
        each = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in runs}
        if each and frozenset() not in each:
            clauses.append(sorted(each, key=sorted))

    def walk(items) -> None:
        runs = {""}
        for item in items:
            more = _strings([item])
            grown = _grow(runs, more) if more is not None else None
            if grown is not None:
                runs = grown
                continue
            close(runs)
            runs = more if more is not None else {""}
            kind, arg = item
            if more is None and kind is op.SUBPATTERN:
                walk(arg[3])
            elif more is None and kind is op.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        close(runs)

    walk(_parser.parse(pattern))
    return clauses


def demanded(rules=RULES) -> list[str]:
    """The trigrams that the rules' queries ask for."""
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for each in clause for t in each})


def postings(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (trigram, doc_id) for the demanded trigrams of every whole text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("low"))
    found = [F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in demanded(rules)]
    if not found:
        return slim.select(F.lit("").alias("trigram"), "doc_id").limit(0)
    return slim.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, one flag per rule with a trigram query) of all documents with a flag: postings intersected by document."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    every = demanded(rules)
    groups = [every[i : i + 62] for i in range(0, len(every), 62)]

    def mask(group: list[str]) -> Column:
        bit = F.lit(0).cast("long")
        for k, t in enumerate(group):
            bit = F.when(F.col("trigram") == t, F.lit(1 << k).cast("long")).otherwise(bit)
        return F.bit_or(bit)

    held = index.groupBy("doc_id").agg(*(mask(g).alias(f"m{i}") for i, g in enumerate(groups)))

    def has(each: frozenset[str]) -> Column:
        out = F.lit(True)
        for i, g in enumerate(groups):
            want = sum(1 << k for k, t in enumerate(g) if t in each)
            if want:
                out = out & (F.col(f"m{i}").bitwiseAND(F.lit(want).cast("long")) == F.lit(want).cast("long"))
        return out

    def meets(query) -> Column:
        out = F.lit(True)
        for clause in query:
            some = F.lit(False)
            for each in clause:
                some = some | has(each)
            out = out & some
        return out

    flags = [meets(q).alias(kind) for kind, q in queries.items()]
    flagged = held.select("doc_id", *flags)
    anyone = F.lit(False)
    for kind in queries:
        anyone = anyone | F.col(kind)
    return flagged.where(anyone)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind, stop>> of the rule's leftmost matches that don't overlap, in code points."""
    shape = "array<struct<start:long,kind:int,stop:long>>"
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    # what lies between matches gives their places
    steps = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), inner.alias("part"))
    steps = F.filter(steps, lambda s: s["hit"].isNotNull())

    def merge(state, s):
        start = state["at"] + F.length(s["gap"])
        stop = start + F.length(s["hit"])
        made = F.array(F.struct(start.cast("long").alias("start"), F.lit(order).alias("kind"), stop.cast("long").alias("stop")))
        keep = F.length(s["part"]) >= rule.least
        return F.struct(stop.cast("long").alias("at"), F.when(keep, F.concat(state["found"], made)).otherwise(state["found"]).alias("found"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(shape).alias("found"))
    return F.aggregate(steps, first, merge, lambda state: state["found"])


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ``found``, an array of (start, kind number, stop) by start, then kind.

    Null texts count as empty. Rows repeated with one id and rows with a null id are scanned each on their own
    text (the candidates of an id are those of all its rows together). An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    index = stage(postings(slim, rules, "doc_id", "text"), "postings")
    flags = candidates(index, rules)
    gated = [c for c in flags.columns if c != "doc_id"]
    flags = flags.select(F.col("doc_id").alias("node"), *(F.col(c).alias("may_" + c) for c in gated))
    # one plan at every size: how many candidates there are isn't known before
    joined = slim.join(flags.hint("merge"), F.col("doc_id").eqNullSafe(F.col("node")), "left")
    none = F.array().cast("array<struct<start:long,kind:int,stop:long>>")
    each = []
    for order, rule in enumerate(rules):
        gate = F.col("may_" + rule.kind) if rule.kind in gated else F.col("text").rlike(rule.pattern)
        each.append(F.when(gate, _spans(F.col("text"), rule, order)).otherwise(none))
    return joined.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def written(found: Column, rules=RULES) -> Column:
    """kind:start:stop of the spans, joined by commas."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (see :func:`scan`)."""
    base = F.filter("found", lambda s: s["kind"] < len(BASE))

    def count(order: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == order)).cast("long")

    counts = [count(k).alias("n_" + r.kind) for k, r in enumerate(BASE)]
    return scan(docs, RULES, id_col, text_col).select(
        "doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans")
    )


def sql() -> str:
    """The same result in SQL, without an index."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, g[i] AS part, "
            "coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a, "
            "length(ms[i]) AS n FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ("
            f"SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', {r.group}) AS g, "
            f"regexp_split_to_array(text, '{p}') AS gaps FROM documents)) WHERE length(g[i]) >= {r.least}"
        )
    return (
        "WITH s AS (" + " UNION ALL ".join(parts) + "), t AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS span FROM s) "
        "SELECT doc_id, "
        + ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
        + f", sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < {len(BASE)}), '')) AS base_sha256, "
        "coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k IS NOT NULL), '') AS spans "
        "FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id"
    )


def matches(text: str | None, rules=RULES) -> list[tuple[int, int, int]]:
    """The spans of one text by plain Python, for tests and spot checks."""
    out = []
    for k, r in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m[r.group]) >= r.least]
    return sorted(out)
