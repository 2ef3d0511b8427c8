"""Codes, probing and neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import multi_index as mi
from orderloom.llm.queries import QUERIES


def brute(ids, x, asked, k):
    out = {}
    for i in np.flatnonzero(np.isin(ids, list(asked))):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(far[j])) for j in order]
    return out


@pytest.mark.parametrize("radius", [0, 3, 17, 40, 64])
def test_probing_meets_every_code_in_reach(radius):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (500, 4), dtype=np.uint16)
    codes[100:200] = codes[0] ^ (np.uint16(1) << rng.integers(0, 16, (100, 4), dtype=np.uint16))
    index = mi.SubstringIndex(codes)
    for q in codes[::50]:
        far = np.bitwise_count(codes ^ q).sum(axis=1)
        assert index.within(q, radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_recall_on_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    got = {}
    for r in QUERIES["op5_multi_index"](spark, folder).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, {i for i in ids.tolist() if i % 100 == 0}, 10)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.95
    for q in want:
        exact = dict(brute(ids, x, {q}, len(ids))[q])
        assert all(exact[v] == s for v, s in got[q].values())


def test_odd_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 30)] + [(100, [0.0, 0.0]), (101, None), (102, [nan, 1.0]), (103, [inf, 1.0])]
    rows += [(104, [None, 1.0]), (None, [1.0, 1.0]), (105, [1.0]), (200, [0.0, 1.0]), (200, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = mi.nearest(df, df.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == list(range(1, 11))
    assert [r.vec_id for r in got if r.query_id == 200] == list(range(10)) and {r.query_id for r in got} == {0, 200}
    few = df.filter("vec_id < 4")
    assert [r.vec_id for r in mi.nearest(few, few.filter("vec_id = 2"), 10).orderBy("rank").collect()] == [0, 1, 3]
    assert mi.nearest(df.limit(0), df.limit(0)).collect() == [] and mi.nearest(df, df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [8192, 40])
def test_blocks_do_not_matter(spark, monkeypatch, block):
    monkeypatch.setattr(mi, "ROW_BLOCK", block)
    monkeypatch.setattr(mi, "QUERY_BLOCK", block)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 8)), np.tile(rng.normal(size=(1, 8)), (150, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in mi.nearest(df, df.filter("vec_id % 5 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(np.arange(len(x)), x, set(range(0, len(x), 5)), 10)
    hits = sum([v for _, v, _ in sorted(got[q])] == [v for v, _ in want[q]] for q in want)
    assert set(got) == set(want) and hits / len(want) > 0.9
