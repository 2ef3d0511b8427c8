"""Summaries and ranks compute their input once, and nothing before they are asked for."""

import random

import pytest
from pyspark.sql import functions as F
from scans import rows_read

from orderloom.catalog import QUERIES
from orderloom.operators.quantiles import describe_values, exact_quantiles, global_rank
from orderloom.plans import gold
from orderloom.sources.standins import Silver


@pytest.fixture
def numbers(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, None if i % 50 == 0 else 7.5 if i % 3 == 0 else rng.lognormvariate(0, 4) * rng.choice([-1, 1])) for i in range(4000)]
    spark.createDataFrame(rows, "k int, v double").repartition(3).write.parquet(f"{tmp_path}/n")
    return spark.read.parquet(f"{tmp_path}/n"), rows


def test_describe_reads_its_input_once(spark, numbers):
    df, rows = numbers
    built = []
    assert rows_read(spark, lambda: built.append(describe_values(df, "v"))) == 0
    got = {}
    assert rows_read(spark, lambda: got.update({r["stat"]: r["value"] for r in built[0].collect()})) == len(rows)
    values = sorted(v for _, v in rows if v is not None)
    at = lambda p: (values[int(p)] + (values[min(int(p) + 1, len(values) - 1)] - values[int(p)]) * (p % 1))
    assert got["count"] == len(values) and got["min"] == values[0] and got["max"] == values[-1]
    for name, share in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75)):
        assert got[name] == pytest.approx(at(share * (len(values) - 1)))


def test_quantiles_read_their_input_once(spark, numbers):
    df, rows = numbers
    assert rows_read(spark, lambda: exact_quantiles(df, "v", [0.1, 0.9]).collect()) == len(rows)


def test_a_rank_reads_an_aggregate_once(spark, numbers):
    df, rows = numbers
    sums = df.groupBy((F.col("k") % 400).alias("g")).agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    got = []
    assert rows_read(spark, lambda: got.extend(global_rank(sums, "s", "place").collect())) == len(rows)
    known = sorted((r["s"] for r in got if r["s"] is not None), reverse=True)
    assert len(got) == 400 and all(r["place"] == (None if r["s"] is None else known.index(r["s"]) + 1) for r in got)


def test_the_sellers_mart_is_computed_once(spark, folder):
    s = Silver(spark, folder)
    mart = gold.mart_seller_performance(s.sellers, s.order_items, s.orders, s.order_reviews)
    alone = rows_read(spark, lambda: mart.select("seller_id", "total_revenue", "late_delivery_rate", "avg_review_score").collect())
    ranked = rows_read(spark, lambda: global_rank(mart.select("seller_id", "total_revenue", "late_delivery_rate", "avg_review_score"), "total_revenue", "r").collect())
    assert ranked == alone


def test_building_the_queries_starts_no_job(spark, folder):
    for name in ("interval_summary", "seller_features", "event_value_summary"):
        assert rows_read(spark, lambda name=name: QUERIES[name](spark, folder)) == 0
