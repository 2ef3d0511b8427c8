"""Trigram queries, and spans against a plain scan."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from orderloom.llm import secret_scan as ss


def test_queries_that_patterns_imply():
    q = ss.trigram_query(ss.RULES[0].pattern)
    assert frozenset({"tok", "oke", "ken"}) in q and frozenset({"api", "pik", "ike", "key"}) in q
    assert ss.trigram_query(ss.RULES[1].pattern) == frozenset({frozenset({"aki", "kia"})})
    assert ss.trigram_query(ss.RULES[2].pattern) is None
    assert ss.trigram_query("ab|cde") is None and ss.trigram_query("(abc)?x*") is None
    assert ss.trigram_query("(abc)+.*(de|df)g") == frozenset({frozenset({"abc", "deg"}), frozenset({"abc", "dfg"})})
    assert ss.trigram_query("abc{2}") == frozenset({frozenset({"abc", "bcc"})})


def brute(text, rules=ss.RULES):
    found = []
    for n, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), n, m.end(), rule))
    found.sort(key=lambda f: f[:2])
    told = lambda some: ",".join(f"{r.kind}:{a}:{b}" for a, _, b, r in some)
    base = told([f for f in found if f[3].base])
    counts = [sum(f[3].kind == r.kind for f in found) for r in rules if r.base]
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), told(found))


TEXTS = [
    "", None, "nothing here", "token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\"",
    "secret: token: abcdefgh", "PassWord='abcdef' API_KEY:xyzxyz apikey=12345", "é\U0001f600 AKIA" + "Z9" * 8 + " AKIAAKIA" + "0" * 12,
    "AKIA" + "A" * 15, "deadbeef" * 3, "x" + "deadbeef" * 3 + "DEADBEEF", "token=token=abcdefgh", "toKen=abcdefgh paſſword=abcdefgh",
    "-----BEGIN RSA PRIVATE KEY-----\nxoxb-123456789012 ghp_" + "a" * 36, "passwd  : \n token:  \"abcdef", "0" * 24 + "g" + "1" * 23 + " " + "2" * 30,
    "secret=" + "a" * 200_000, ("token = abcdefgh " * 3000), "\x00\r\ntoken=abcdefg\x00", "toke\nn=abcdefgh",
]


def test_scan(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("k1", F.lit("clash"))
    got = ss.scan(docs.repartition(3)).collect()
    want = sorted(str((i, *brute(t))) for i, t in rows)
    assert sorted(str((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans)) for r in got) == want
    assert ss.scan(docs.limit(0)).collect() == []


@pytest.mark.parametrize("rules", [ss.RULES[:1], ss.RULES[2:3], ss.RULES[1:2] + ss.RULES[3:4]])
def test_fewer_rules(spark, rules):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in ss.scan(docs, rules).collect()}
    assert got == {i: brute(t, rules)[-1] for i, t in enumerate(TEXTS)}
