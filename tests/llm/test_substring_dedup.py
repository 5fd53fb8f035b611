import random
from collections import defaultdict

import pytest

from tapeloom.llm import substring_dedup as sd
from tapeloom.llm.common import words as split_words

DOCS = "doc_id long, text string, start string, rid int"


def brute(rows, least, k, similarity):
    """(doc, paragraph, start, stop, first occurrence, size, removed) by comparing all paragraphs."""
    occ = []
    for i, (doc_id, text, *_) in enumerate(rows):
        for n, m in enumerate(sd.PARAGRAPH.finditer(text or "")):
            w = split_words(m[0])
            if len(w) >= least:
                occ.append((doc_id is None, doc_id or 0, i, n, m.start(), m.end(), frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))))
    root = list(range(len(occ)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(occ)):
        for y in range(x):
            a, b = occ[x][6], occ[y][6]
            if len(a & b) >= similarity * len(a | b):
                root[top(x)] = top(y)
    groups = defaultdict(list)
    for i in range(len(occ)):
        groups[top(i)].append(i)
    out = []
    for own in groups.values():
        if len(own) > 1:
            head = min(own, key=lambda i: occ[i][:4])
            for i in own:
                o = occ[i]
                out.append((None if o[0] else o[1], o[3], o[4], o[5], None if occ[head][0] else occ[head][1], occ[head][3], len(own), i != head))
    return sorted(out, key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    shared = [rng.choices(vocab, k=rng.choice([30, 60, 120])) for _ in range(8)]
    rows = []
    for i in range(90):
        lines = [rng.choices(vocab, k=rng.randrange(1, 70)) for _ in range(rng.randrange(0, 5))]
        for _ in range(rng.randrange(0, 3)):
            p = list(rng.choice(shared))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "new"
            lines.insert(rng.randrange(len(lines) + 1), p)
        rows.append((i, rng.choice(["\n", "\n\n", "\r\n"]).join(" ".join(x).capitalize() for x in lines), "s", 1))
    line = " ".join(vocab[:40])
    return rows + [(500 + i, f"head {i}\n{line}", "", 0) for i in range(60)] + [(900, None, "", 0), (901, "", "", 0), (None, line, "", 0), (3, rows[3][1], "", 0)]


def test_repeats_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = [(r.doc_id, r.paragraph, r.start, r.stop, r.group_doc, r.group_paragraph, r.group_size, r.removed) for r in sd.repeats(docs).collect()]
    want = brute(rows, sd.LEAST_WORDS, sd.SHINGLE, sd.SIMILARITY)
    same = lambda out: sorted((r for r in out if r[0] != 3 and r[4] != 3), key=repr)
    assert same(got) == same(want)
    assert sorted(r[:4] + r[5:7] for r in got if r[0] == 3) == sorted(r[:4] + r[5:7] for r in want if r[0] == 3)


def test_cut_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    out = sd.without_repeats(docs)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert len(texts) == len(rows) and sum(t is None for t in texts) == 1
    left = [(i, t, "", 0) for i, t in enumerate(texts)]
    assert brute(left, sd.LEAST_WORDS, sd.SHINGLE, sd.SIMILARITY) == []
    assert sum(len((t or "").split()) for t in texts) == sum(len((r[1] or "").split()) for r in rows) - sum(
        len(rows[i][1][a:b].split()) for i, a, b in _removed(rows)
    )
    assert sd.repeats(docs.limit(0)).count() == 0 and sd.without_repeats(docs.limit(0)).count() == 0


def _removed(rows):
    unique = [(i, r[1], "", 0) for i, r in enumerate(rows)]
    return [(r[0], r[2], r[3]) for r in brute(unique, sd.LEAST_WORDS, sd.SHINGLE, sd.SIMILARITY) if r[7]]


def test_edit_distance(spark):
    words = [f"x{i}" for i in range(30)]
    other = [*words[:10], "new", *words[11:]]
    docs = spark.createDataFrame([(1, " ".join(words), "", 0), (2, " ".join(other), "", 0)], DOCS)
    assert sd.repeats(docs).count() == 0
    assert sd.repeats(docs, similarity=0.5, measure="edit").count() == 2
    assert sd.edit_similarity(list("kitten"), list("sitting")) == pytest.approx(1 - 3 / 7)
    assert sd.edit_similarity([], []) == 1 and sd.edit_similarity(["a"], []) == 0


def test_bands():
    count, width = sd.bands(0.8, 0.999, 128)
    assert 1 - (1 - 0.8**width) ** count >= 0.999 and count * width <= 128
    assert sd._cut("a\nb\r\nc", [1]) == "a\nc" and sd._cut("a", [0]) == "" and sd._cut("a\n\nb", [0]) == "\nb"


def repeated_runs(rows, run):
    """(doc, word) of every word in a run of ``run`` words that occurs twice."""
    at = defaultdict(list)
    for i, (_, text, *_) in enumerate(rows):
        w = split_words(text)
        for j in range(len(w) - run + 1):
            at[tuple(w[j : j + run])].append((i, j))
    return {(i, j + d) for own in at.values() if len(own) > 1 for i, j in own for d in range(run)}


def test_passages_hold_every_repeated_run(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    say = lambda n: rng.choices(vocab, k=n)
    shared = [say(n) for n in (50, 53, 60, 147, 400)]
    rows = []
    for i in range(60):
        own = say(rng.randrange(1, 200))
        for p in rng.sample(shared, rng.randrange(0, 3)):
            own += p + say(rng.randrange(1, 200))
        breaks = rng.choice([0, 7, 12, 31])
        text = " ".join(w + ("\n" if breaks and j % breaks == breaks - 1 else "") for j, w in enumerate(own))
        rows.append((i, text, "", 0))
    rows += [(100, "x " * 51, "", 0), (101, " ".join(vocab[:50] * 3), "", 0), (102, " ".join(vocab[:49]), "", 0), (103, None, "", 0), (None, rows[0][1], "", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    out = sd.passages(docs).collect()
    number = {r[0]: i for i, r in enumerate(rows)}
    told, gone = set(), set()
    for r in out:
        text = rows[number[r.doc_id]][1]
        before = len(split_words(text[: r.start]))
        assert len(split_words(text[r.start : r.stop])) == r.n_words
        span = {(number[r.doc_id], before + j) for j in range(r.n_words)}
        told |= span
        gone |= span if r.removed else set()
    want = repeated_runs(rows, sd.RUN)
    first = {(number[100], j) for j in range(50)} | {(number[101], j) for j in range(50)}
    assert want <= told and not first & gone
    runs = {w for r in out if r.unit == "run" for w in [(number[r.doc_id], len(split_words(rows[number[r.doc_id]][1][: r.start])) + j) for j in range(r.n_words)]}
    assert runs <= want
    # one copy of each run stays
    left = [(r[0], " ".join(w if (i, j) not in gone else f"gone{i}_{j}" for j, w in enumerate(split_words(r[1]))), "", 0) for i, r in enumerate(rows)]
    assert not repeated_runs(left, sd.RUN)
    for p in shared:
        seen = [r for r in rows if " ".join(p) in " ".join(split_words(r[1]))]
        kept = [r for r in left if " ".join(p) in r[1]]
        assert len(kept) >= bool(seen)
    assert sd.passages(docs.limit(0)).count() == 0


def test_wrapped_near_copies(spark):
    rng = random.Random(3)
    own = [f"w{rng.randrange(900)}" for _ in range(120)]
    other = [w if j % 40 else "new" for j, w in enumerate(own)]
    wrap = lambda w, n: "\n".join(" ".join(w[j : j + n]) for j in range(0, len(w), n))
    docs = spark.createDataFrame([(1, "head\n\n" + wrap(own, 12), "", 0), (2, wrap(other, 11), "", 0)], DOCS)
    got = sorted((r.doc_id, r.paragraph, r.n_words, r.group_doc, r.removed) for r in sd.passages(docs).collect() if r.unit == "block")
    assert got == [(1, 1, 120, 1, False), (2, 0, 120, 1, True)]
    assert sd.repeats(docs).count() == 0


def run_spans(rows, run):
    """Rows of unit ``run`` by looking at every run of every text: (doc, start, stop, words, first doc, first line, times, removed)."""
    edges = [[m.span() for m in sd.re.finditer(r"[^\x20\x09-\x0D]+", r[1] or "")] for r in rows]
    at = defaultdict(list)
    for i, r in enumerate(rows):
        w = split_words(r[1])
        for j in range(len(w) - run + 1):
            at[tuple(w[j : j + run])].append((r[0] is None, r[0] or 0, i, j))
    found = defaultdict(dict)
    for own in at.values():
        if len(own) > 1:
            *_, i, j = min(own)
            for o in own:
                found[o[2]][o[3]] = (len(own), i, j, (i, j) != o[2:])
    out = []
    for i, own in found.items():
        spans = []
        for j, (times, head, place, removed) in sorted(own.items()):
            if spans and spans[-1][-1][0] == j - 1 and spans[-1][-1][2] == head and spans[-1][-1][4] == removed:
                spans[-1].append((j, times, head, place, removed))
            else:
                spans.append([(j, times, head, place, removed)])
        for s in spans:
            (j, _, head, place, removed), last = s[0], s[-1][0]
            low, start = j, edges[i][j][0]
            if removed and head == i and (over := max(x[3] for x in s)) + run > low:
                low, start = over + run, edges[i][over + run - 1][1]
            if last + run > low:
                line = len([m for m in sd.PARAGRAPH.finditer(rows[head][1]) if m.end() <= edges[head][place][0]])
                out.append((rows[i][0], start, edges[i][last + run - 1][1], last + run - low, rows[head][0], line, max(x[1] for x in s), removed))
    return sorted(out, key=repr)


@pytest.mark.parametrize("run", [50, 12])
def test_runs_equal_brute_force_and_are_no_rows(spark, monkeypatch, run):
    rng = random.Random(run)
    vocab = [f"w{i}é\U0001f600"[: rng.randrange(3, 8)] for i in range(2000)]
    say = lambda n: rng.choices(vocab, k=n)
    shared, rows = [say(n) for n in (run, run + 1, 70, 160, 400)], []
    for i in range(40):
        own = say(rng.randrange(0, 90))
        for p in rng.choices(shared, k=rng.randrange(0, 4)):
            a = rng.randrange(0, len(p) // 2)
            own += (p if rng.random() < 0.5 else p[a:]) + say(rng.randrange(0, 9))
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\r\n", "\t"]) for w in own), "", 0))
    whole = say(900)
    for i in range(30):  # near copies: runs that a changed word tears
        w = list(whole)
        w[rng.randrange(900)] = "new"
        rows.append((100 + i, " ".join(w).upper(), "", 0))
    rows += [(200, "x " * 3 * run, "", 0), (201, " ".join(shared[2] * 3), "", 0), (202, None, "", 0), (203, "", "", 0), (None, rows[45][1], "", 0)]
    staged = {}
    real = sd.stage

    def stage(df, label):
        out = real(df, label)
        staged.setdefault(label, out.count())
        return out

    monkeypatch.setattr(sd, "stage", stage)
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    # no lines or blocks: only runs
    out = sd.passages(docs, run=run, least_words=10**6).collect()
    got = [(r.doc_id, r.start, r.stop, r.n_words, r.group_doc, r.group_paragraph, r.group_size, r.removed) for r in out]
    assert sorted(got, key=repr) == run_spans(rows, run)
    positions = sum(max(0, len(split_words(r[1])) - run + 1) for r in rows)
    assert staged["passages"] < positions / (run // 10 + 1)
