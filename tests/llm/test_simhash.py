"""Fingerprints, links and components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orderloom.llm import graphs, simhash


def slow_fingerprint(text):
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(codes, radius=4):
    codes, group = list(dict.fromkeys(codes)), {}
    for c in codes:
        mates = {c} | {m for o, g in list(group.items()) if (o ^ c).bit_count() <= radius for m in g}
        for m in mates:
            group[m] = mates
    return {frozenset(g) for g in group.values()}


@pytest.mark.parametrize(
    "text", ["", None, "One", "a B  c\td", "a b c d e É\x1cf g", " x y z w \x85 v", "the of the of the of the of"]
)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert set(np.bitwise_count(order[1:] ^ order[:-1]).tolist()) == {1}


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_all_components(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    codes = []
    for c in centres:
        for _ in range(int(rng.integers(1, 120))):
            flips = rng.choice(64, int(rng.integers(0, 8)), replace=False)
            codes.append(int(c) ^ sum(1 << int(f) for f in flips))
    index = simhash.GrayIndex(np.array(codes, np.uint64))
    index.link(4, batch=16)
    groups = {}
    for c, l in zip(index.codes.tolist(), index.labels.tolist()):
        groups.setdefault(l, set()).add(c)
    assert {frozenset(g) for g in groups.values()} == slow_components(codes)


@pytest.mark.parametrize("cell", [4096, 5])
def test_documents(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, ""), (1, None), (2, " \n"), (3, "lone")]
    for i in range(4, 60):
        rows.append((i, " ".join(rng.choice(words, 60))))
    for i in range(60, 160):
        text = rows[4 + i % 7][1].split()
        text[int(rng.integers(60))] = "new"
        rows.append((i, " ".join(text)))
    rows += [(200, rows[5][1]), (200, rows[5][1]), (None, rows[6][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    docs = docs.withColumn("code", F.lit(1)).repartition(3)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    codes = {r: slow_fingerprint(r[1]) for r in rows}
    groups = slow_components(codes.values())
    smallest = {c: min(r[0] for r in rows if r[0] is not None and codes[r] in g) for g in groups for c in g}
    assert sorted((r.fingerprint, r.component_id) for r in got) == sorted(
        (f"{codes[r]:016x}", smallest[codes[r]]) for r in rows
    )
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(smallest.values()))


def test_empty_and_unnamed(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == [] and simhash.keep_first(docs).collect() == []
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (None, "zz zz")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_first(docs).collect()) == ["a", "zz zz"]


def test_components_of_a_long_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(12)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 13)} | {100 + i: 100 for i in range(1, 60)}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).collect() == []
