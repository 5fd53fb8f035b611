import random

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import common, ngram_join
from tapeloom.llm.common import words
from tapeloom.llm.components import components
from tapeloom.llm.linking import STAR, LocalStars, SlotFilter, _centred, star_pairs

SCHEMA = "doc_id long, text string, node string, n_shingles int"


def sets(rows, k):
    out = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        out[doc_id] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute(rows, k, percent):
    s = sets(rows, k)
    ids = [i for i in s if i is not None]
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x in ids:
        for y in ids:
            both = len(s[x] & s[y])
            if x < y and both and 100 * both >= percent * len(s[x] | s[y]):
                a, b = root(x), root(y)
                comp[max(a, b)] = min(a, b)
    return {i: (len(s[i]), root(i)) for i in ids}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = rng.choices(vocab, k=45)
    base = [rng.choices(vocab, k=rng.choice([1, 3, 6, 12, 40, 90, 300])) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.25:
            w = common + rng.choices(vocab, k=rng.randrange(1, 12))
        if rng.random() < 0.1:
            w = w + w[: len(w) // 12]
        rows.append((i, " ".join(w) if rng.random() < 0.5 else "\n".join(w).upper(), "x", 1))
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_components_match_brute_force(spark, seed, k, percent):
    rows = corpus(seed) + [(900, None, None, None), (901, "", "", 0), (902, " \n ", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.label(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)
    kept = ngram_join.deduplicate(docs, k, percent)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "", 0), (None, "a b c d e f", "", 0), (5, "a b c d e f", "", 0), (5, "a b c d e f", "", 0)], SCHEMA)
    got = sorted((tuple(r) for r in ngram_join.label(docs).collect()), key=repr)
    assert got == [(5, 2, 5), (5, 2, 5), (None, 2, None), (None, 2, None)]
    assert ngram_join.label(docs.limit(0)).count() == 0
    assert ngram_join.deduplicate(docs).count() == 4


def test_pigeonhole_never_misses():
    bands, rng, sets_ = ngram_join.Bands(85), np.random.default_rng(5), []
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        most = bands.differing(2 * n)
        drop = int(rng.integers(0, most + 1))
        sets_ += [np.unique(a), np.unique(np.r_[a[drop:], rng.integers(0, 2**63, int(rng.integers(0, most - drop + 1))).astype(np.uint64)])]
    offsets = np.cumsum([0] + [len(s) for s in sets_])
    slots = [set() for _ in sets_]
    for keys, doc in ngram_join.segments(np.concatenate(sets_), offsets, bands):
        for key, d in zip(keys.tolist(), doc.tolist(), strict=True):
            slots[d].add(key)
    short = ngram_join.sketches(np.concatenate(sets_), offsets).view(np.uint64)
    linked = 0
    for i in range(0, len(sets_), 2):
        a, b = sets_[i], sets_[i + 1]
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 85 * (len(a) + len(b) - both):
            linked += 1
            assert slots[i] & slots[i + 1]
            assert sum(int(v).bit_count() for v in short[i] ^ short[i + 1]) <= len(a) + len(b) - 2 * both
    assert linked > 100


def test_shingles_equal_word_sequences(monkeypatch):
    rng = random.Random(8)
    texts = ["", None, " \n", "A b\tc", "a B c", "a b", "É é", "x" * 500, "a b c d e a b c d e"]
    texts += [" ".join(rng.choices(["aa", "b", "Cc", "\x1cd", "é", "\n"], k=rng.randrange(0, 200))) for _ in range(60)]
    for size in (64, 1 << 20):
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        hashes, offsets = common.shingles([t if t is None else t.encode() for t in texts], 3)
        names = {}
        for i, text in enumerate(texts):
            w = words(text)
            want = {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} if w else set()
            got = hashes[offsets[i] : offsets[i + 1]].tolist()
            assert len(got) == len(want) and got == sorted(set(got))
            for s in want:
                names.setdefault(s, set(got))
                names[s] &= set(got)
        assert all(names.values()) and len(set().union(*names.values())) >= len(names)


def test_slot_filter(spark):
    slots = [5, -7, 2**62, -(2**63), 123456789]
    kept = SlotFilter.of(spark.createDataFrame([(s,) for s in slots], "slot long"))
    assert kept.has(np.array(slots)).all() and not kept.has(np.arange(1000, 2000)).any()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r[0]: r[1] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 99}


def test_wide_sketches_spare_large_unlike_sets(spark):
    rng = random.Random(4)
    long = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (3000, 3000, 2500, 900)]
    near = long[0].split()
    near[70:300] = [f"x{i}" for i in range(230)]
    texts = [long[0], " ".join(near), long[1], long[0][: len(long[0]) * 9 // 10], long[2], long[3]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, "a b c d e f g"), (2, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "id long, text string")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 3), (2, 0), (4, 0), (5, 0), (4, 2)], "id long, rep long")
    got = {tuple(r) for r in ngram_join.closer(pairs, ngram_join.facts(docs, 4), 85).collect()}
    # 4 and 2 hold a second, short text each, which the wide sketches say nothing about
    assert got == {(0, 1), (0, 3), (4, 2)}
    linked = {tuple(r) for r in ngram_join.verified(docs, pairs, 4, 85).collect()}
    assert linked == got


def test_pairs_are_no_rows_of_each_part(spark):
    slots = random.Random(3).sample(range(1 << 40), 400)
    batches = []
    for task in range(4):
        stars = LocalStars(32)
        for node in range(task * 50, task * 50 + 50):
            stars.add(node, [s for s in slots if (s + node) % 3])
        stars.sure(1000 + task, task)
        batches.append(stars.batch())
    rows = [r for b in batches for r in b.to_pylist()]
    stars = spark.createDataFrame([tuple(r.values()) for r in rows], STAR)
    dealt = stars.repartition(1, "part").sortWithinPartitions("part").mapInArrow(_centred(32), "part int, ids array<long>, reps array<long>, slots array<long>")
    assert dealt.count() <= 32
    pairs = {(r.id, r.rep): sorted(r.slots) for r in star_pairs(stars, 32).collect()}
    assert len(pairs) == star_pairs(stars, 32).count()
    assert [pairs.pop((1000 + task, task)) for task in range(4)] == [[]] * 4
    tree = {s: {0 if s % 3 else 1} for s in slots}
    for (a, b), shared in pairs.items():
        for s in shared:
            assert (s + a) % 3 and (s + b) % 3
            tree[s] |= {a, b}
    # the pairs of a slot hold all its members and hang together
    assert all(len(tree[s]) >= sum(1 for n in range(200) if (s + n) % 3) for s in slots)


def test_bounded_batches_hold_every_row(monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * n for n in (10, 990, 5, 4000, 1, 2, 500, 499, 3)])], names=["id", "text"])
    parts = list(common.bounded([batch]))
    assert [len(p) for p in parts] == [2, 1, 1, 3, 2] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
