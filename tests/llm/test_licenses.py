import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import licenses as li

DOCS = "doc_id long, text string, p string, license int"
SHIPPED = "/usr/share/common-licenses"
GPL = "This work is licensed under the GNU General Public License, version 3."


def prose(rng, n):
    return " ".join(rng.choices([f"word{i}" for i in range(200)] + ["the", "of", "is", "under"], k=n))


def rows():
    rng = random.Random(9)
    out = []
    for i in range(120):
        text = prose(rng, rng.randrange(1, 60))
        if i % 10 == 0:
            text += "\n" + rng.choice(li.TEMPLATES)[1]
        if i % 25 == 3:
            text = "// Licensed under the Apache License,\n// Version 2.0\n\n" + text
        out.append((i, text, f"a/{'b/' * (i % 3)}f{i}", 0))
    out += [(500, GPL, "a/LICENSE", 0), (501, "Released under the MIT License.", "a/b//COPYING", 0), (502, "plain words", "a/b/c/d/x", 0), (503, "plain", "z/x", 0)]
    return out + [(504, None, "a/y", 0), (505, "", None, None), (506, GPL, None, 0), (None, "plain", "/a/b/q", 0), (502, "plain words", "a/b/c/d/x", 0), (507, "x " * 90_000 + "\n" + GPL, "q", 0)]


def brute(data):
    df, n = Counter(), len(data)
    vocabulary = {t for _, text in li.TEMPLATES for t in li.terms(text)}
    for _, text, *_ in data:
        df.update(set(li.terms(text or "")) & vocabulary)
    idf = lambda t: (math.log((1 + n) / (1 + df[t])) if t in vocabulary else math.log(1 + n)) + 1

    def cosine(text, template):
        a, b = Counter(), Counter(li.terms(template))
        for j, t in enumerate(li.terms(text)):
            a[t if t in vocabulary else (t, j)] += 1
        w = lambda t: idf(t if isinstance(t, str) else t[0])
        dot = sum(c * b[t] * w(t) ** 2 for t, c in a.items())
        return dot / math.sqrt(sum((c * w(t)) ** 2 for t, c in a.items()) * sum((c * idf(t)) ** 2 for t, c in b.items())) if a else 0

    def best(text):
        c, name = max(((cosine(text, t), name) for name, t in li.TEMPLATES), key=lambda x: x[0])
        return (c, name) if c >= li.THRESHOLD else None

    own = []
    for _, text, path, _ in data:
        text = text or ""
        if hit := best(text):
            own.append(("file", *hit))
            continue
        parts = [p for block in text.split("\n\n") for p in (*block.split("\n"), block)]
        hits = [h for p in parts if (h := best(p))]
        own.append(("header", *max(hits, key=lambda h: h[0])) if hits else None)
    folder = lambda p: [x for x in p.split("/") if x][:-1]
    given = {}
    for (_, _, path, _), o in zip(data, own, strict=True):
        if o and o[0] == "file" and path is not None:
            key = tuple(folder(path))
            given[key] = min(given.get(key, (0.0, "")), (-round(o[1], 9), o[2]))
    out = []
    for (doc_id, _, path, _), o in zip(data, own, strict=True):
        if o:
            out.append((doc_id, o[2], o[0], None))
            continue
        up = tuple(folder(path)) if path is not None else None
        while up is not None and up not in given:
            up = up[:-1] if up else None
        out.append((doc_id, None, "none", None) if up is None else (doc_id, given[up][1], "inherited", "/".join(up)))
    return sorted(out, key=repr)


def test_scan_equals_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame(data, DOCS).repartition(5)
    got = li.scan(docs, F.col("p")).collect()
    assert sorted(((r.doc_id, r.license, r.origin, r.license_dir) for r in got), key=repr) == brute(data)
    assert {r.origin for r in got} == {"file", "header", "inherited", "none"}
    assert all((r.score >= li.THRESHOLD) == (r.origin in ("file", "header")) for r in got)
    assert li.scan(docs.limit(0), F.col("p")).count() == 0


def test_directories(spark):
    df = spark.createDataFrame([("a/b/c",), ("x",), ("a/x",)], "p string").select(li.ancestors(li.directory(F.col("p"))).alias("u"))
    assert [r.u for r in df.collect()] == [["", "a", "a/b"], [""], ["", "a"]]


#: the complete texts as Debian ships them
COMPLETE = {
    "Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0",
}


@pytest.mark.skipif(not os.path.isdir(SHIPPED), reason="no complete licence texts on this machine")
def test_complete_texts_are_inherited(spark):
    texts = {name: open(f"{SHIPPED}/{name}", encoding="utf-8").read() for name in COMPLETE}
    rng = random.Random(4)
    data = [(i, prose(rng, 50), "other/x", 0) for i in range(200)]
    for i, (name, text) in enumerate(texts.items()):
        data += [(1000 + i, text, f"r{i}/LICENSE", 0), (2000 + i, prose(rng, 30), f"r{i}/src/x.py", 0)]
        # a program that carries the whole text is no licence file
        assert li.full_text(text)[1] == COMPLETE[name] and li.full_text(text + "code " * len(li.terms(text))) is None
    got = {r.doc_id: r for r in li.scan(spark.createDataFrame(data, DOCS), F.col("p")).collect()}
    for i, license in enumerate(COMPLETE.values()):
        own, below = got[1000 + i], got[2000 + i]
        assert (own.license, own.origin) == (license, "file") and own.score >= li.THRESHOLD
        assert (below.license, below.origin, below.license_dir) == (license, "inherited", f"r{i}")


def test_full_text_without_files():
    filler = "words of the terms " * 300
    agpl = f"GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007\n{filler}13. Remote Network Interaction; {filler}\nEND OF TERMS AND CONDITIONS"
    by = f'Creative Commons Attribution-ShareAlike 4.0 International Public License\n{filler}Adapter\'s License {filler}\nSection 8 -- Interpretation.'
    assert li.full_text(agpl)[1] == "AGPL-3.0" and li.full_text(by)[1] == "CC-BY-SA-4.0"
    assert li.full_text(agpl[:-30]) is None and li.full_text(agpl + "code " * 3000) is None and li.full_text("license") is None
