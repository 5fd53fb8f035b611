import hashlib
import re
from collections import defaultdict

import pytest

from tapeloom.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, _own_rid int"


def brute(rows):
    groups = defaultdict(list)
    for i, (doc_id, text, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc_id is None, doc_id or 0, i))
    out = []
    for body, own in groups.items():
        own.sort()
        for j, (none, doc_id, _) in enumerate(own):
            keep = None if own[0][0] else own[0][1]
            out.append((None if none else doc_id, keep, len(own), j == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def case_rows():
    rows = [(i, f"text number {i % 7}" + "\t \n" * (i % 3), f"k{i}", i) for i in range(60)]
    rows += [(100, None, None, None), (101, "", None, 1), (None, "text number 1", "z", 2), (None, None, "z", 2)]
    rows += [(103, "x" * 300_000, "", 0), (102, "x" * 300_000, "", 0), (7, rows[7][1], "k7", 7), (104, "é ü", "", 0)]
    rows += [(200 + i, f"same length {i:03d} " + "abc" * (i % 2), "", 0) for i in range(80)]
    return rows


@pytest.mark.parametrize("budget", [exact_dedup.TRIE_BYTES, 900])
def test_owners(spark, budget):
    rows = case_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in exact_dedup.owners(docs, budget=budget).collect()), key=repr)
    want = brute(rows)
    assert [g for g in got if g[0] != 7] == [w for w in want if w[0] != 7]
    assert sorted(g[3] for g in got if g[0] == 7) == sorted(w[3] for w in want if w[0] == 7)


def test_deduplicate_keeps_columns(spark):
    docs = spark.createDataFrame(case_rows(), SCHEMA)
    kept = exact_dedup.deduplicate(docs)
    assert kept.schema == docs.schema
    assert kept.count() == len({exact_dedup.normalise(r[1]) for r in case_rows()})
    assert exact_dedup.owners(docs.limit(0)).count() == 0


def test_trie_gives_up_subtrees():
    trie = exact_dedup.Trie()
    keys = [b"aaa1", b"aaa2", b"aab1", b"bbbb"]
    for k in keys:
        trie.terminal(k, lambda k=k: [k])
    assert sorted(k for k, _ in trie.owners()) == keys
    prefix, rows = trie.give_up()
    assert prefix == b"aa" and sorted(k for k, _ in rows) == keys[:3]
    assert trie.terminal(b"aaz9", list) is None and trie.terminal(b"bbbb", list) == [b"bbbb"]
    assert trie.terminal(b"abcd", lambda: ["new"]) == ["new"]
