"""Spelling variants against plain generation of all edits."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orderloom.llm import spelling

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, typos):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typos and h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    letters = sorted({c for w in n for c in w})
    out, form = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = sorted((e for e in edits - {w} if e in n), key=lambda e: (-n[e], e))
        form[w] = near[0] if near and n[near[0]] >= 2 * n[w] else None
        out[w] = [form[w], None, n[w], len(near), n[near[0]] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {(w, *rest) for w, rest in out.items()}


def compare(spark, rows, typos):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({"n": F.lit("clash"), "word": F.lit(1), "h": F.lit(None).cast("int")})
    got = spelling.variants(docs.repartition(3), typos).collect()
    assert len(got) == len({r.word for r in got})
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(rows, typos)
    return got


def made_up(seed, docs):
    rng = random.Random(seed)
    stems = ["colour", "straße", "theatre", "élève", "aaaaa", "aaaaaa", "centre", "hello", "naïve", "x" * 70]
    letters = "abcdeé×ßz"

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
        return w.upper() if rng.random() < 0.2 and w.isascii() else w

    glue = [" ", "-", "1", ". ", "ā", "\U0001f600", "µ", "\x00"]
    return [(i, "".join(word() + rng.choice(glue) for _ in range(rng.randrange(40, 90)))) for i in range(docs)]


@pytest.mark.parametrize("typos", [None, 7, 97])
def test_variants_equal_brute_force(spark, typos):
    rows = made_up(typos or 1, 60)
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (70, None), (71, ""), (72, " \n12 ")]
    got = compare(spark, rows, typos)
    assert any(r.form for r in got) and any(r.root != (r.form or r.word) for r in got)


def test_filters_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ROUND", 7)
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    monkeypatch.setattr(spelling, "PROBES", 64)
    compare(spark, made_up(5, 30), None)


def test_very_long_text_and_word(spark):
    long = "colour color " * 60_000 + "y" * 3000 + " " + "y" * 2999 + "z"
    compare(spark, [(1, long), (2, long), (3, long), (4, "colours"), (5, "é" * 9)], 97)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "word")], "doc_id long, text string"), 97).collect() == []


def test_ties_go_to_the_first_form(spark):
    rows = [(1, "abcde " * 3 + "abcdf " * 6 + "abcda " * 6 + "ébcda " * 12 + "zzzzz " * 2)]
    got = {r.word: (r.form, r.root, r.n_near) for r in compare(spark, rows, None)}
    assert got["abcde"] == ("abcda", "ébcda", 2) and "zzzzz" not in got
