"""One key with a third of all rows: the same results, with adaptive execution splitting at small sizes."""

import pytest
from pyspark.sql import functions as F

from orderloom.operators.merge import merge_upsert
from orderloom.operators.profile import sequence_gaps, sequence_verdicts
from orderloom.operators.quantiles import exact_quantiles, global_rank
from orderloom.plans import gold

N = 60_000


@pytest.fixture(scope="module", params=["broadcast", "shuffle"])
def skewed(spark, request):
    """Items of which a third belong to one order, one seller and one product."""
    if request.param == "shuffle":
        small = {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        }
    else:
        small = {}
    for k, v in small.items():
        spark.conf.set(k, v)
    hot = F.col("id") % 3 == 0
    items = spark.range(N).select(
        F.when(hot, 0).otherwise(F.col("id")).alias("order_id"),
        (F.col("id") + 1).cast("int").alias("order_item_id"),
        F.when(hot, 0).otherwise(F.col("id") % 100).alias("product_id"),
        F.when(hot, 0).otherwise(F.col("id") % 50).alias("seller_id"),
        (F.col("id") % 1000).cast("decimal(18,4)").alias("price"),
        F.lit(1).cast("decimal(18,4)").alias("freight_value"),
    )
    stamp = F.expr("timestamp_ntz'2018-01-01 00:00:00'")
    orders = spark.range(N).select(
        F.col("id").alias("order_id"),
        F.when(hot, 7).otherwise(F.col("id") % 500).alias("customer_id"),
        F.lit("delivered").alias("order_status"),
        stamp.alias("order_purchase_timestamp"),
        stamp.alias("order_approved_at"),
        stamp.alias("order_delivered_carrier_date"),
        stamp.alias("order_delivered_customer_date"),
        stamp.alias("order_estimated_delivery_date"),
    )
    customers = spark.range(500).select(
        F.col("id").alias("customer_id"), F.col("id").alias("customer_unique_id"), F.lit("c").alias("customer_city"),
        F.lit("SP").alias("customer_state"),
    )
    sellers = spark.range(50).select(F.col("id").alias("seller_id"), F.lit("c").alias("seller_city"), F.lit("SP").alias("seller_state"))
    products = spark.range(100).select(
        F.col("id").alias("product_id"), F.lit("cat").alias("product_category_name"), F.lit(1).alias("product_photos_qty"),
        *[F.lit(1).cast("decimal(18,4)").alias(c) for c in ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")],
    )
    reviews = spark.range(N).select(
        F.col("id").alias("review_id"), F.when(hot, 0).otherwise(F.col("id")).alias("order_id"), (F.col("id") % 5 + 1).cast("int").alias("review_score")
    )
    payments = items.select("order_id", F.col("order_item_id").alias("payment_sequential"), F.lit("card").alias("payment_type"),
                            F.lit(1).alias("payment_installments"), F.col("price").alias("payment_value"))
    yield {"items": items, "orders": orders, "customers": customers, "sellers": sellers, "products": products,
           "reviews": reviews, "payments": payments}
    for k in small:
        spark.conf.unset(k)


HOT_PRICE = sum(i % 1000 for i in range(0, N, 3))


def test_sales_fact_keeps_every_row(skewed):
    t = skewed
    fact = gold.fact_sales_items(t["items"], t["orders"], t["products"], t["sellers"], t["customers"], t["payments"])
    got = fact.agg(F.count("*"), F.countDistinct("order_item_key"), F.sum("price"), F.count("customer_city")).first()
    assert tuple(got) == (N, N, sum(i % 1000 for i in range(N)), N)
    hot = fact.filter("order_id = 0").agg(F.count("*"), F.sum("price"), F.min("payment_type")).first()
    assert tuple(hot) == (N // 3, HOT_PRICE, "card")


def test_marts_of_the_hot_keys(skewed):
    t = skewed
    seller = gold.mart_seller_performance(t["sellers"], t["items"], t["orders"], t["reviews"]).filter("seller_id = 0").first()
    others = [i for i in range(N) if i % 3 and i % 50 == 0]
    assert seller["total_items_sold"] == N // 3 + len(others) and seller["total_orders"] == 1 + len(others)
    # Every item of the hot order meets every one of its reviews; no pair is ever built.
    score = sum(i % 5 + 1 for i in range(0, N, 3)) * (N // 3) + sum(i % 5 + 1 for i in others)
    pairs = (N // 3) ** 2 + len(others)
    assert seller["avg_review_score"] == pytest.approx(score / pairs)
    monthly = gold.mart_monthly_from_items(t["items"], t["orders"]).first()
    assert monthly["total_orders"] == 1 + N - N // 3
    assert gold.mart_monthly_performance(gold.sold_items(t["items"], t["orders"])).first() == monthly
    buyer = gold.mart_customer_behavior(t["customers"], t["orders"], t["items"]).filter("customer_unique_id = 7").first()
    assert buyer["total_items_bought"] == N // 3 + sum(1 for i in range(N) if i % 3 and i % 500 == 7)


def test_fulfillment_has_one_row_per_order(skewed):
    t = skewed
    fact = gold.fact_order_fulfillment(t["orders"], t["customers"], t["reviews"], t["items"], t["sellers"])
    assert fact.count() == N
    hot = fact.filter("order_id = 0").first()
    assert hot["seller_id"] == 0 and hot["review_score"] == 3


def test_sequences_and_quantiles(skewed):
    payments = skewed["payments"]
    verdicts = sequence_verdicts(payments, "order_id", "payment_sequential")
    broken = verdicts.filter(~F.col("is_contiguous")).count()
    assert verdicts.count() - broken == 0 and broken == 1 + N - N // 3
    assert sequence_gaps(payments, "order_id", "payment_sequential").count() == N
    values = skewed["items"].select(F.when(F.col("order_id") == 0, 5).otherwise(F.col("order_id") % 10).alias("v"))
    got = {r["probability"]: r["value"] for r in exact_quantiles(values, "v", (0.25, 0.5, 0.75)).collect()}
    ordered = sorted(5 if i % 3 == 0 else i % 10 for i in range(N))
    assert got == {p: pytest.approx(_quantile(ordered, p)) for p in got}


def _quantile(ordered, p):
    at = p * (len(ordered) - 1)
    low = int(at)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)


def test_global_rank_with_a_hot_value(skewed):
    df = skewed["items"].select("order_item_id", F.when(F.col("order_id") == 0, 500).otherwise(F.col("order_id") % 1000).alias("v"))
    got = {r["v"]: r["pos"] for r in global_rank(df, "v", "pos").select("v", "pos").distinct().collect()}
    counts = {}
    for i in range(N):
        v = 500 if i % 3 == 0 else i % 1000
        counts[v] = counts.get(v, 0) + 1
    position = 1
    for v in sorted(counts, reverse=True):
        assert got[v] == position
        position += counts[v]


def test_a_hot_duplicate_fails_the_merge(skewed):
    source = skewed["items"].select("order_id", "price")
    with pytest.raises(Exception, match="duplicate merge key: 0"):
        merge_upsert(source.limit(0), source, ["order_id"]).count()


def test_adaptive_execution_splits_the_hot_order(spark, skewed):
    if spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1":
        pytest.skip("only where joins shuffle")
    t = skewed
    fact = gold.fact_sales_items(t["items"], t["orders"], t["products"], t["sellers"], t["customers"], t["payments"])
    fact.collect()
    plan = fact._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("SortMergeJoin(skew=true)") >= 3, plan
