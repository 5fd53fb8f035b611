import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import spelling

ROW = "doc_id long, text string, word string, n int"


def brute(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    n = {w: c for w, c in found.items() if len(w) >= 5 and c >= 3}

    def edits(w):
        alphabet = [chr(c) for c in [*range(97, 123), *range(192, 256)]]
        out = {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        return out - {w}

    form, near = {}, {}
    for w in n:
        own = [x for x in edits(w) if x in n]
        near[w] = len(own)
        top = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], None if form[w] is None else n[form[w]]))
    return sorted(out)


def texts(seed=1, docs=220):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿÀ") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    out = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = rng.choice(base[: rng.randint(1, 60)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abÿ") + w[at + 1 :]])
            words.append(rng.choice([w, w.upper(), w.capitalize()]))
        out.append((i, rng.choice([" ", ", ", "\n", "ſ", "9"]).join(words)))
    return out


@pytest.mark.parametrize("chunk", [7, spelling.CHUNK])
def test_equals_brute_force(spark, chunk):
    rows = texts() + [(1000, None), (1001, ""), (1002, "123 -- İı"), (None, "hello hello hello hellp hellp hellp"), (7, "hello hello hello hello"), (7, "hello")]
    rows += [(1003, "a" * 3000 + " " + "a" * 2999 + "b"), (1004, "a" * 3000), (1005, "a" * 3000 + " " + "a" * 2999 + "b"), (1006, "a" * 2999 + "b")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ROW).repartition(5)
    got = spelling.variants(df, chunk=chunk)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert sum(1 for r in want if r[1]) > 50 and any(r[1] != r[2] for r in want if r[1])
    assert sorted(map(tuple, got.collect())) == want


def test_none(spark):
    assert spelling.variants(spark.createDataFrame([], ROW)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "", 0)], ROW)).count() == 0


def test_one_edit():
    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(60)]

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, e = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(e[j] + 1, d[-1] + 1, e[j - 1] + (x != y)))
        return d[-1]

    p, n = spelling.letters(words)
    i, j = (x.ravel() for x in np.meshgrid(range(60), range(60)))
    got = spelling.one_edit(p[i], n[i], p[j], n[j])
    assert got.tolist() == [distance(words[a], words[b]) == 1 for a, b in zip(i, j, strict=True)]
