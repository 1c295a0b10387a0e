from __future__ import annotations

import random
import re

from answerloom.llm import secret_scan as S

ASSIGN = re.compile(S.BASE[0].pattern, re.A)


def slow(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for rank, rule in enumerate(S.FORMATS, 3):
        found += [(m.start(), rank, rule.kind, m.end()) for m in re.finditer(rule.pattern, text)]
    return sorted(found)


def test_by_brute_force(spark):
    draw = random.Random(4)
    parts = ["password", "PassWd", "secret", "api_key", "apikey", "token", "=", ":", " ", '"', "'", "abc", "abcdef", "é😀",
             "AKIA", "ABCD1234EFGH5678", "0123456789abcdef01234567", "ghp_", "a" * 36, "xoxb-", "sk_live_", "AIza", "b" * 35,
             "-----BEGIN RSA PRIVATE KEY-----", "eyJ", "c" * 9, "."]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 14))) for _ in range(300)]
    texts += ["secret=token:abcdefgh", 'password : "token=abc"', "AKIAAKIA" + "A" * 15, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [tuple(s) for s in r.secrets] for r in S.scan_secrets(docs).collect()}
    for ix, text in enumerate(texts):
        assert got[ix] == slow(text), text


def test_many_matches_in_one_text(spark):
    """More matches than are added up at once, also exactly as many."""
    texts = ["x token=abcdef " * n + "AKIA" + "B" * 20 for n in (1, 255, 256, 257, 512, 2000)] + ["password: 0123456 😀" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [tuple(s) for s in r.secrets] for r in S.scan_secrets(docs).collect()}
    for ix, text in enumerate(texts):
        assert got[ix] == slow(text)


def test_trigram_queries():
    query = S.trigram_query
    assert query("AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert query("[0-9a-f]{24,}") == [] and query("ab|cdef") == [] and query("a?b*") == []
    assert query("abc|xyz") == [[frozenset({"abc"}), frozenset({"xyz"})]]
    assert query("abc.*xyz") == [[frozenset({"abc"})], [frozenset({"xyz"})]]
    assert query("abc(def)?") == [[frozenset({"abc"})]]


def test_awkward_rows(spark, awkward, nothing):
    rows = S.scan_secrets(awkward).collect()
    assert len(rows) == awkward.count() and all(r.secrets == [] for r in rows)
    assert S.scan_secrets(nothing).collect() == []
