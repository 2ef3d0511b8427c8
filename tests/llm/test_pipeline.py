"""The stages one after the other, each against what its operator says of its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from orderloom.llm import decontaminate, mixing, pu_quality, simhash


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(cp.written(stage(spark, out[-1], folder), "stage"))
    return folder, out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    _, (docs, *rest) = stages
    assert all(d.columns == docs.columns for d in rest[:-1])
    assert rest[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality(spark, stages):
    folder, (docs, good, *_) = stages
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = pu_quality.score(docs, pu_quality.train(docs, labels))
    assert ids(good) == ids(scored.filter(F.col("score") >= pu_quality.THRESHOLD)) and 0 < good.count() < docs.count()


def test_one_document_of_each_group(stages):
    _, (_, good, unique, *_) = stages
    groups = simhash.near_duplicates(good).collect()
    assert ids(unique) == sorted({r.component_id for r in groups})


def test_no_benchmark_item_is_left(spark, stages):
    folder, (_, _, unique, clean, *_) = stages
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    held = {r.doc_id for r in decontaminate.leaks(unique, benchmark).collect()}
    assert held and ids(clean) == sorted(set(ids(unique)) - held)


def test_mix_and_tokens(stages):
    _, (_, _, _, clean, mixed, tokens) = stages
    times = {r.doc_id: r.times for r in mixing.mix(clean).collect() if r.times}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == times
    rows = sorted(tokens.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == ids(mixed)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_columns_that_are_called_like_the_stages_own_come_out_as_they_were(spark, stages):
    folder, (docs, *_) = stages
    names = ["_held_k1", "_held_k2_", "_text_or_empty", "_row_digest", "_id", "_digest", "_cut", "_whole", "_times", "_again", "_mix_source", "score", "_own_score", "_SCORE"]
    marked = docs.limit(200).withColumns({n: F.concat(F.lit(f"{n} "), "doc_id") for n in names})
    for i, (_, stage) in enumerate(cp.STAGES[:-1]):
        marked = cp.written(stage(spark, marked, folder), f"clash-{i}")
        assert marked.columns == [*docs.columns, *names]
    rows = marked.collect()
    assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)
    assert cp.STAGES[-1][1](spark, marked, folder).count() == len(rows)
