"""Scores against a model kept in dictionaries, whose distributions are shown to add up to one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import katz

START, END = "<start>", "<end>"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[ \t\n\v\f\r]+", low) if w] + [END]


class Plain:
    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            own = tokens(t)
            self.words.update(own)
            self.pairs.update(zip([START, *own], own))
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.dw, self.dp = self.factors(self.words), self.factors(self.pairs)
        self.context = Counter()
        self.after = defaultdict(list)
        for (a, b), c in self.pairs.items():
            self.context[a] += c
            self.after[a].append(b)
        self.rest = 1 - sum(self.dw(c) * c for c in self.words.values()) / (self.n + 1)

    @staticmethod
    def factors(counts):
        of = Counter(counts.values())
        for k in range(5, 0, -1):
            if all(of[r] for r in range(1, k + 2)):
                rest = (k + 1) * of[k + 1] / of[1]
                if rest != 1:
                    d = {r: ((r + 1) * of[r + 1] / of[r] / r - rest) / (1 - rest) for r in range(1, k + 1)}
                    if all(0 < x <= 1 for x in d.values()):
                        return lambda c, d=d: d.get(c, 1.0)
        return lambda c: 1 - 0.5 / c if c <= 5 else 1.0

    def word(self, w):
        c = self.words[w]
        return self.dw(c) * c / (self.n + 1) if c else self.rest

    def alpha(self, v):
        if not self.context[v]:
            return 1.0
        seen = sum(self.pair(v, w) for w in self.after[v])
        return (1 - seen) / (1 - sum(self.word(w) for w in self.after[v]))

    def pair(self, v, w):
        c = self.pairs[v, w]
        return self.dp(c) * c / (self.context[v] + 1) if c else self.alpha(v) * self.word(w)

    def score(self, text):
        own = tokens(text)
        return sum(math.log10(self.pair(v, w)) for v, w in zip([START, *own], own))

    def base(self, text):
        return sum(math.log10((self.words[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in tokens(text))


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, 301)
    words = [f"W{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 40)), p=weights / weights.sum())) for _ in range(n)]
    texts += ["", None, "é\x85 Ü", "new words never seen", "the\tthe\n the", "same text", "same text"]
    return list(enumerate(texts)) + [(None, "no id at all"), (3, texts[3]), (3, texts[3])]


@pytest.mark.parametrize("n, chunk, piece", [(400, 3_000_000, 4 << 20), (60, 200, 16), (1, 50, 4 << 20)])
def test_scores(spark, monkeypatch, n, chunk, piece):
    rows = corpus(n)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    plain = Plain([t for i, t in rows if not held(i)])
    for v in [START, "w0", "w7", "never"]:
        total = plain.rest * plain.alpha(v) + sum(plain.pair(v, w) for w in plain.words)
        assert abs(total - 1) < 1e-9
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("train", F.lit(0))
    # The limits are read in the tasks, so they travel as defaults of what is sent.
    made = katz._make_chunks

    def small(batches, _size=chunk, _piece=piece):
        katz.CHUNK, katz.SLICE = _size, _piece
        return made(batches)

    monkeypatch.setattr(katz, "_make_chunks", small)
    got = sorted(map(str, ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.score(docs.repartition(3)).collect())))
    want = sorted(
        str((i, held(i), len(tokens(t)), sum(plain.words[w] > 0 for w in tokens(t)), plain.n, round(plain.base(t), 6), round(plain.score(t), 6)))
        for i, t in rows
    )
    assert got == want


@pytest.mark.parametrize("place", ["first", "last"])
def test_text_longer_than_a_chunk(spark, monkeypatch, place):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    rng = np.random.default_rng(5)
    long = " ".join(f"w{i}" for i in rng.integers(0, 30, 300))
    rest = [(i, " ".join(f"w{j}" for j in rng.integers(0, 30, 12))) for i in range(2, 30)]
    rest += [(i, "never seen in front") for i in range(30, 60)]
    rows = [(1, long), *rest] if place == "first" else [*rest, (1, long)]
    assert not held(1) and any(held(i) for i, _ in rest)
    plain, made = Plain([t for i, t in rows if not held(i)]), katz._rows_and_chunks

    def small(batches):  # sent by value, so the limits are set in the worker
        before = katz.CHUNK, katz.SLICE
        katz.CHUNK, katz.SLICE = 50, 100
        try:
            yield from made(batches)
        finally:
            katz.CHUNK, katz.SLICE = before

    monkeypatch.setattr(katz, "_rows_and_chunks", small)
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: round(r.score, 6) for r in got} == {i: round(plain.score(t), 6) for i, t in rows}


def test_stretches_of_a_text(monkeypatch):
    text = ("Aa bb  ccc\n" * 50 + "x" * 300 + " y\tz ").encode()
    whole = [katz.word_key(w) for w in text.lower().split()]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(katz, "SLICE", size)
        assert np.concatenate(list(katz._word_keys(text))).tolist() == whole


def test_packed_arrays():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 56, 1000, dtype=np.uint64))
    assert (katz.restore_keys(katz.squeeze_keys(keys)) == keys).all()
    cuts = katz._cuts(keys, 7)
    assert cuts[0] == 0 and cuts[-1] == len(keys)
    assert all((int(k) * 7) >> 56 == p for p in range(7) for k in keys[cuts[p] : cuts[p + 1]])
    assert len(katz.restore(katz.squeeze(np.zeros(0, "<u4")), "<u4")) == 0


def test_only_held_out_rows_and_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(docs).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = katz.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 3, 0, 0, 0.0, 0.0)]
