"""Phrases against plain counting, with small budgets, and the SQL counterpart."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import phrases

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, share, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(_LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for p, a in candidates.items():
        lang, words = p[0], p[1:]
        if any(
            len(q) > len(p) and q[0] == lang and share * a <= 100 * b and any(q[i : i + len(words)] == words for i in range(1, len(q)))
            for q, b in candidates.items()
        ):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, *words[:k]], f[lang, *words[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def made_up(seed, n, words=40):
    rng = random.Random(seed)
    lexicon = ["a", "b", "the", "of", "New", "york", "é", "x-y", "c\x01d", "12", "ſ", "big", "city"]
    fixed = ["new york city", "of the big apple", "the the the the the the", "x-y\té  12"]
    rows = []
    for _ in range(n):
        said = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(lexicon) for _ in range(rng.randrange(words))]
        glue = [rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "?!"]) for _ in said]
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), "".join(w + g for w, g in zip(said, glue))))
    return rows


def compare(spark, rows, least=3, share=100, top=2000, **more):
    docs = spark.createDataFrame(rows, "lang string, text string")
    docs = docs.withColumns({"n": F.lit("clash"), "rank": F.lit(0), "suffix": F.lit("x"), "doc_id": F.lit(1)})
    got = phrases.phrases(docs.repartition(3), least, share, top, **more).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, least, share, top)
    return got


@pytest.mark.parametrize("least, share, budget, filtered", [(3, 100, 100_000, 3), (1, 60, 5, 1), (2, 100, 1, 5), (5, 80, 12, 2)])
def test_phrases_equal_plain_counts(spark, least, share, budget, filtered):
    rows = made_up(least, 60) + [(None, None), ("en", ""), ("en", " \n . "), ("de", "solo")]
    assert len(compare(spark, rows + rows[:5], least, share, budget=budget, filtered=filtered)) > 10


def test_top_of_each_language(spark):
    assert max(r["rank"] for r in compare(spark, made_up(9, 50), 2, top=7)) == 7


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PART", 50)
    monkeypatch.setattr(phrases, "HELD", 30)
    rows = made_up(3, 12, words=400) + [("en", "w" * 700 + " one two three four five six seven" * 9), ("en", "a b c d e")]
    compare(spark, rows, 2, budget=20)


def test_very_long_text(spark):
    compare(spark, [("en", "new york is big and new york is old " * 40_000), ("en", "y" * 3_000_000)], 100)


def test_full_bit_maps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MAP_BITS", 7)
    compare(spark, made_up(5, 40), 3, budget=9)


def test_products_beyond_64_bits(spark):
    big = 3_000_000_019
    found = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 2)], "lang string, word string, n long")
    totals = spark.createDataFrame([("en", 10**15 + 7)], "lang string, n long")
    row = phrases.scored(found, words, totals).first()
    assert row.score == 1000 * big * (10**15 + 7) // (big * (big + 2))


def test_subtree_totals():
    rows = [["a", "b"], ["a", "b", "c"], ["a", "c"], ["a", "b", "c", "d", "e"], ["b", "a"]]
    found = {(depth, tuple(rows[i][:depth])): t for depth, leaves, totals in phrases.subtree(rows, np.array([1, 2, 4, 8, 16])) for i, t in zip(leaves.tolist(), totals.tolist())}
    assert found[2, ("a", "b")] == 11 and found[3, ("a", "b", "c")] == 10 and found[5, tuple("abcde")] == 8 and len(found) == 6


def test_no_documents(spark):
    assert phrases.phrases(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.phrases(spark.createDataFrame([("en", "too few words")], "lang string, text string")).collect() == []
