"""Repeated byte strings against a count of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import repeats

N = repeats.MATCH


def brute(texts):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + N] for t in texts for i in range(len(t) - N + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - N + 1):
            if seen[t[i : i + N]] > 1:
                gone[i : i + N] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = np.random.default_rng(5)

    def noise(n):
        return "".join(rng.choice(list("abcdefgh ij\né"), n))

    passage, long_passage = noise(450), noise(3000)
    texts = ["", None, "short", noise(399), noise(400), noise(5000)]
    texts += [noise(int(rng.integers(1, 300))) + passage + noise(int(rng.integers(1, 300))) for _ in range(25)]
    texts += [noise(50) + long_passage[a : a + 1400] + noise(70) for a in range(0, 1500, 211)]
    texts += [noise(300) + passage[:399] + noise(30), noise(9) + passage[25:424] + noise(900)]
    texts += ["word " * 300, "x" * 401, "x" * 400, "y" * 1000, texts[5], texts[5], texts[4]]
    edited = list(long_passage)
    edited[1500] = "#"
    texts += ["".join(edited), noise(500) * 2, long_passage[:400]]
    return texts


@pytest.mark.parametrize("group", [2000, 3])
def test_against_all_windows(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "PART_WINDOWS", 2000)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("gram", F.lit("clash"))
    got = {r.doc_id: r for r in repeats.remove_repeats(docs.repartition(4)).collect()}
    for i, want in enumerate(brute(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, (i, texts[i] and texts[i][:40])
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).collect() == []
    docs = spark.createDataFrame([(7, "q" * 399 + "r"), (7, "q" * 399 + "r"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs, with_bytes=False).collect()) == [(0, 0), (400, 400), (400, 400)]


def test_sliding_least():
    rng = np.random.default_rng(0)
    for n, w in [(1, 1), (7, 3), (100, 351), (1000, 351), (351, 351)]:
        v = rng.integers(0, 1000, n).astype(np.uint64)
        want = [int(v[i : i + w].min()) for i in range(n - w + 1)]
        if want:
            assert repeats._sliding_least(v, w).tolist() == want
