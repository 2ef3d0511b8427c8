"""Quality scores: held-out accuracy, the prior, odd rows, and what the driver holds."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import pu_quality as pu
from orderloom.llm.queries import QUERIES


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    p, u = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert abs(pu.class_prior(p, u) - 0.7) < 0.06


def test_risk_separates_a_known_mixture():
    rng = np.random.default_rng(2)
    clean, junk = rng.normal(1, 1, (3000, 6)), rng.normal(-1, 1, (600, 6))
    x = np.concatenate([clean[:1500], clean[1500:], junk]).astype(np.float32)
    scores = pu.fit(x, np.arange(len(x)) < 1500).score(x)
    assert (scores[:3000] >= 0.7).mean() > 0.9 and (scores[3000:] < 0.7).mean() > 0.9


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op2_pu_quality"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    good = np.mean([r.predicted for r in rows if r.quality == 1])
    bad = np.mean([1 - r.predicted for r in rows if r.quality == 0])
    print(len(rows), right, good, bad)
    assert right > 0.97 and good > 0.97 and bad > 0.85
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("text", [b"", b"a", b"\xff\xfe", b"word " * 200_000, "é!\n".encode()])
def test_features_of_any_text(text):
    x = pu.features(text)
    assert x.shape == (pu.WIDTH,) and np.isfinite(x).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "good text here"), (1, "good text here"), (2, None), (None, ""), (3, "!!!! &&& ***")], "doc_id long, text string"
    ).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = pu.score(docs, pu.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert pu.keep_good(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert {r.score for r in pu.score(docs, pu.train(docs, none)).collect()} == {0.5}
    assert pu.score(docs.limit(0), pu.train(docs.limit(0), labels)).collect() == []


def test_without_a_model_all_documents_stay(spark):
    docs = spark.createDataFrame([(1, "a text", 3), (2, None, 4), (None, "no id", 5)], "doc_id long, text string, score long")
    for rows in ([], [(1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        kept = pu.keep_good(docs, labels)
        assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_the_driver_holds_its_sample_little_more_than_once(spark):
    text = F.concat_ws(" ", *(F.md5((F.col("id") * k).cast("string")) for k in range(1, 6)))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    n = docs.filter(~pu.held_out(F.col("doc_id"))).count()
    tracemalloc.start()
    try:
        assert pu.train(docs, labels) is not None
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2.2 * (2 * n * 4 * pu.WIDTH)  # every row is in both samples


def test_training_in_place_gives_the_same_model():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 150)).astype(np.float32)
    x[:400] += 0.5
    before, positive = x.copy(), np.arange(900) < 400
    apart = pu.fit(x, positive)
    assert np.array_equal(x, before)
    within = pu.fit(x, positive, in_place=True)
    assert not np.array_equal(x, before)
    assert all(np.array_equal(a, b) for a, b in zip(apart.weights, within.weights))
    assert np.array_equal(apart.mean, within.mean) and np.array_equal(apart.scale, within.scale)
    assert np.array_equal(apart.scale, np.maximum(before.std(0), 1e-3))
