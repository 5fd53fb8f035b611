import hashlib
import random
import re

import pytest

from tapeloom.llm import secrets

DOCS = "doc_id long, text string, found string, low int"
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def plain(text):
    """The base spans as the contract states them."""
    out = []
    for k, (kind, (pattern, keep)) in enumerate(BASE.items()):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if keep(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def texts():
    rng = random.Random(11)
    bits = ["password", "PassWD", "secret", "ToKen", "api_key", "APIkey", '"', "'", " ", "  ", ":", "=", " = ", "AKIA", "AKIA" * 3, "0123456789abcdef", "deadbeef"]
    bits += ["Ab9+/_.=-", "ABCDEFGHIJKLMNOP", "é😀", "\n", "words of text", "ghp_" + "a1B2" * 9, "xoxb-1234567890ab", "ſecret: abcdefghijklmnop", "tokeN=abcdefghijkl"]
    bits += ["-----BEGIN RSA PRIVATE KEY-----", "AIza" + "x" * 35, "eyJabcdefghijk.eyJabcdefghijk.abcdefghijk"]
    return ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(500)]


def test_base_spans_follow_the_contract():
    for text in texts():
        got = [f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in secrets.matches(text, secrets.BASE)]
        assert got == plain(text), text


def test_report(spark):
    rows = [(i, t, "", 0) for i, t in enumerate(texts())]
    rows += [(900, None, "", 0), (901, "", None, None), (None, "token=abcdefghijklmnop", "", 0), (None, "none", "", 0), (3, "secret: 0123456789abcdef", "", 0)]
    rows += [(902, "a" * 40 + " z " * 100_000 + "password=" + "q" * 30, "", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = sorted((tuple(r) for r in secrets.report(docs).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        base = plain(text)
        spans = ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in secrets.matches(text))
        n = [sum(s.startswith(k) for s in base) for k in BASE]
        want.append((doc_id, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), spans))
    assert got == sorted(want, key=repr)
    assert secrets.report(docs.limit(0)).count() == 0
    assert "Python" not in secrets.report(docs)._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "pattern,clauses",
    [
        (r"AKIA[A-Z0-9]{14,}", [[{"aki", "kia"}]]),
        (r"[0-9a-f]{16,}", []),
        (r"x(abc|de)?y", []),
        (r"(?:abcd|xyz)[0-9]+qrs", [[{"abc", "bcd"}, ], [{"qrs"}]]),
        (r"ab*cde", [[{"cde"}]]),
        (r"(foo.+bar)+", [[{"foo"}], [{"bar"}]]),
    ],
)
def test_queries(pattern, clauses):
    got = secrets.trigram_query(pattern)
    if "xyz" in pattern:
        clauses = [[{"abc", "bcd"}, {"xyz"}], [{"qrs"}]]
    assert [[set(e) for e in c] for c in got] == clauses


def test_every_match_meets_its_query():
    for text in texts():
        low = text.lower()
        for rule in secrets.RULES:
            if re.search(rule.pattern, text, re.ASCII):
                for clause in secrets.trigram_query(rule.pattern):
                    assert any(all(t in low for t in each) for each in clause)
