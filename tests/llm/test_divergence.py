import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapeloom.llm import divergence

ROW = "doc_id long, text string, lang string, source string, term string, value int"


def brute(rows, least=10):
    count, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        count.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    kept = defaultdict(list)
    for (lang, term), n in docs.items():
        if n >= least:
            kept[lang].append(term)
    out = []
    for lang, source in groups:
        own = [s for x, s in groups if x == lang]

        def p(name, lang=lang, own=own):
            of = [own if name is None else [name]][0]
            n = {t: sum(count[lang, s, t] for s in of) for t in kept[lang]}
            total = sum(n.values()) + 2 * len(kept[lang])
            return {t: 1 + 10**9 * (n[t] + 2) // total for t in kept[lang]}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine, whole = p(source), p(None)
        pair = [(s, sum(f(mine[t], q) for t, q in p(s).items())) for s in own if s != source]
        term = [(t, f(mine[t], whole[t])) for t in kept[lang] if count[lang, source, t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pair, None), ("term", term, 10)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda r: (-r[1], r[0].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def texts(n=260):
    rng = random.Random(2)
    vocabulary = ["Wort", "WORD", "éte", "日本", "a", "𐍈x", "don", *(f"w{chr(97 + i)}" for i in range(20))]
    return [
        (i, rng.choice([" ", "-", "\n", "'s "]).join(rng.choices(vocabulary, k=rng.choice([0, 3, 60]))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "s2", "", None, "é"]), "t", 1)
        for i in range(n)
    ]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(divergence, "SHARD_ROWS", 13)
    rows = texts() + [(900, None, "fr", "lonely", "", 0), (901, "x " * 90_000, "fr", "long", "", 0), (902, "", "xx", "a", "", 0), (903, "...", "xx", "b", "", 0)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, ROW).repartition(4)
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_slices_and_flushes_change_nothing(spark, monkeypatch):
    rows = texts(200)
    df = spark.createDataFrame(rows, ROW).coalesce(1)
    want = brute(rows)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 40)
    monkeypatch.setattr(divergence, "HELD_ROWS", 30)
    assert sorted(map(tuple, divergence.audit(df).collect())) == want


def test_none(spark):
    assert divergence.audit(spark.createDataFrame([], ROW)).count() == 0


def test_exact_scaling():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 2**52, 500)
    count = (total * rng.random(500)).astype(np.int64)
    assert divergence.scaled(count, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(count, total, strict=True)]
