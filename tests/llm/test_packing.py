import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a<|endoftext|>b  <|startoftext|> <|ENDOFTEXT|>.",
    "é́. x y z\x85w",
    "don't 'S I'll we'Re can't!!! 'd.",
    "İ ΑΣ ΣΑΣ, Straße.",
    "1234 5\x1c6 a_b _a_ a1. 1a, ²x",
    "́a.́ ###$$$ | |x|",
    "THE the The,The.",
    "J\u030c j\u030c H\u0331x T\u0308 I\u0307 K\u0327",
    "\n\t ",
]


def test_ids_equal_the_tokenizer_on_whole_texts():
    words, plain = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    letters = ["a", "Ab", "é", "é", "ß", "Σ", "1", "٣", "'s", "'", ".", ",", "$", "_", "-", "日本", "‍", "😀", "|", "<"]
    texts = ODD + [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(12)) for _ in range(400)]
    split = [packing.chunks(text.encode()) for text in texts]
    words.learn([*split[::2], [b"x" * 300]])
    for text, own in zip(texts, split, strict=True):
        got = np.frombuffer(b"".join(map(words.__getitem__, own)), "<u4").tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids, text
    words.LIMIT = 5
    words.forget()
    words.learn(split)
    assert b"".join(map(words.__getitem__, split[-1])) == np.array(plain.encode(texts[-1], add_special_tokens=False).ids, "<u4").tobytes()


def check_plan(counts, capacity, runs, sequences):
    seen, fill = defaultdict(set), defaultdict(list)
    for length, rank, n, first, offset in runs:
        for i in range(n):
            assert rank + i not in seen[length]
            seen[length].add(rank + i)
            fill[first + i].append((offset, length))
    assert {n: len(s) for n, s in seen.items()} == {n: c for n, c in counts.items() if c}
    assert all(max(s) == len(s) - 1 for s in seen.values())
    assert set(fill) == set(range(sequences))
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("low,high,n", [(1, 100, 500), (10, 60, 900), (34, 50, 300), (100, 100, 7), (1, 1, 950)])
def test_plan(low, high, n):
    rng = random.Random(n)
    counts = Counter(rng.randint(low, high) for _ in range(n))
    for shares in (packing.LARGE, (1 / 8,), (1 / 3,)):
        runs, sequences = packing.plan(counts, 100, 8, shares)
        check_plan(counts, 100, runs, sequences)
    total = sum(k * v for k, v in counts.items())
    assert packing.plan(counts, 100)[1] <= 1.12 * max(-(-total // 100), sum(v for k, v in counts.items() if k > 50)) + 1 or low > 33


def test_configurations_reach_a_known_optimum():
    sizes, demand = [60, 40, 30], [30, 30, 40]
    found = packing.configurations(sizes, demand, 100)
    made = sum(np.array(c) * n for c, n in found)
    assert (made <= demand).all() and sum(n for _, n in found) <= 43
    assert packing._knapsack([60, 40, 30], np.array([1.0, 0.7, 0.5]), 100)[0] == pytest.approx(1.7)


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta,", "Gamma."], k=rng.choice([0, 3, 20, 45]))), 0, "x") for i in range(120)]
    rows += [(500, None, 0, ""), (500, "alpha", 0, ""), (None, "beta", 0, ""), (501, "alpha beta " * 400, 0, ""), (502, "z" * 5000, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, at string").repartition(5)
    got = packing.pack(docs, PATH, 50).collect()
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 50)):
            part = np.array(ids[at : at + 50], "<u4")
            want[(doc_id, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 50
    assert packing.pack(docs.limit(0), PATH).count() == 0
