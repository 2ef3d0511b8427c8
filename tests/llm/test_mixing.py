"""Targets against a plain water-filling loop, and what is taken against the targets."""

import re

import pytest
from pyspark.sql import functions as F

from orderloom.llm import mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
        open_ -= over
    return target


def brute(rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, _) in enumerate(rows)}
    sizes = {}
    for i, (_, _, s) in enumerate(rows):
        sizes[s] = sizes.get(s, 0) + size[i]
    return size, sizes


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(["w"] * (1 + i * 7 % 40)), f"s{i % 5}") for i in range(900)]
    out += [(1000 + i, "one two\tthree", None) for i in range(30)] + [(2000, None, "s1"), (2001, "", "s1"), (2002, "\x85 x", "é")]
    out += [(3000 + i, " ".join(["w"] * 9), "Z") for i in range(1500)] + [(None, "a b", "s2"), (5, "dup", "s0"), (5, "dup", "s0")]
    return out + [(4000, "", "hollow")]


def test_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs.repartition(5)).withColumnRenamed("target", "t").collect()
    size, sizes = brute(rows)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(r[0]), size[i]) for i, r in enumerate(rows))
    want = plain_targets(sizes)
    by = {r.source_size: r for r in got}
    assert {round(r.t, 6) for r in got} == {round(t, 6) for t in want.values()}
    taken = {}
    for r in got:
        taken[r.t] = taken.get(r.t, 0) + r.taken
        assert r.taken <= 3 * r["size"]
    for t in taken:  # sources may share a target
        sources = sum(round(w, 6) == round(t, 6) for w in want.values())
        assert abs(taken[t] - t * sources) <= 20 * sources
    assert len(by) == len(set(sizes.values()))


def test_rows_of_the_mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(1))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixing.mix(docs).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + r.times
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in times.items() if v}
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, mixing.mix(docs).collect()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == [] and mixing.mixed(docs).collect() == []
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0)] * 2
