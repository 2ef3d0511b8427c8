"""Gold facts and marts.

Rules that keep the plans good at scale:

* anything that only needs one row per order (payments, reviews, item totals) is reduced to one row per
  order before it is joined, so no join repeats rows and an order with very many items collapses map-side;
* items are shuffled on the order key once. The columns of an order are joined together first, and shuffled
  by order again before they meet the items: only a join with an exchange on either side can be split by
  adaptive execution, and one order may hold very many items;
* distinct counts of orders become plain counts on data that already has one row per order;
* dimensions carry no broadcast hint: Spark broadcasts one whose size is below its threshold, and
  otherwise sort-merges with adaptive skew splitting on the fact side.

Keys (order_id, customer_id, product_id, seller_id) are unique in their own silver table; the silver
load enforces that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions import composite_key, days_between, exact_avg, month_bucket, round_half_up_int
from orderloom.operators.dedupe import dedupe_first

DELIVERED = "delivered"


def primary_payments(payments: DataFrame) -> DataFrame:
    """The largest payment of each order; an unknown value counts as largest, ties go to the earlier payment."""
    order = [F.col("payment_value").desc_nulls_first(), F.col("payment_sequential").asc_nulls_last()]
    return dedupe_first(payments, ["order_id"], order).select("order_id", "payment_type", "payment_installments")


def primary_sellers(items: DataFrame, sellers: DataFrame) -> DataFrame:
    """The known seller of each order's most expensive item; ties go to the lower item number."""
    known = items.select("order_id", "order_item_id", "seller_id", "price").join(
        sellers.select("seller_id", "seller_city", "seller_state"), "seller_id"
    )
    order = [F.col("price").desc_nulls_first(), F.col("order_item_id").asc_nulls_last()]
    return dedupe_first(known, ["order_id"], order).select("order_id", "seller_id", "seller_city", "seller_state")


def order_scores(reviews: DataFrame) -> DataFrame:
    """Sum and number of review scores per order."""
    return reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("score_sum"), F.count("review_score").alias("score_count")
    )


def sold_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items with their order: the columns of the sales fact that money and time questions need."""
    head = orders.select("order_id", "customer_id", "order_status", "order_purchase_timestamp")
    return items.join(head, "order_id").withColumn("total_value", F.col("price") + F.col("freight_value"))


def fact_sales_items(
    items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    customers: DataFrame,
    payments: DataFrame,
) -> DataFrame:
    """One row per order item with order, product, seller, customer and main payment."""
    heads = (
        orders.select("order_id", "customer_id", "order_status", "order_purchase_timestamp")
        .join(primary_payments(payments), "order_id", "left")
        .join(customers.select("customer_id", "customer_city", "customer_state"), "customer_id", "left")
    )
    wide = (
        items.join(heads, "order_id")
        .join(
            products.select(
                "product_id",
                "product_category_name",
                "product_weight_g",
                "product_length_cm",
                "product_height_cm",
                "product_width_cm",
            ),
            "product_id",
            "left",
        )
        .join(sellers.select("seller_id", "seller_city", "seller_state"), "seller_id", "left")
    )
    return wide.select(
        composite_key("order_id", "order_item_id").alias("order_item_key"),
        "order_id",
        "order_status",
        "order_purchase_timestamp",
        "product_id",
        "product_category_name",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
        "seller_id",
        "seller_city",
        "seller_state",
        "customer_id",
        "customer_city",
        "customer_state",
        "payment_type",
        "payment_installments",
        "price",
        "freight_value",
        (F.col("price") + F.col("freight_value")).alias("total_value"),
    )


def fulfillment_heads(orders: DataFrame, customers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Orders with a known customer, their delivery times and their review: the fulfillment fact without sellers."""
    scores = order_scores(reviews).select(
        "order_id", round_half_up_int(exact_avg("score_sum", "score_count")).alias("review_score")
    )
    buyers = customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state")
    purchase, delivered = F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    return (
        orders.join(scores, "order_id", "left")
        .join(buyers, "customer_id")
        .withColumns(
            {
                "delivery_days_actual": days_between(delivered, purchase),
                "delivery_days_estimated": days_between(estimated, purchase),
                "processing_days": days_between("order_delivered_carrier_date", "order_approved_at"),
                "is_late_delivery": delivered > estimated,
            }
        )
    )


def fact_order_fulfillment(
    orders: DataFrame, customers: DataFrame, reviews: DataFrame, items: DataFrame, sellers: DataFrame
) -> DataFrame:
    """One row per order with a known customer: main seller, delivery times, review."""
    # The sellers join on order_id comes first: orders are then already laid out by order for the reviews.
    with_seller = orders.join(primary_sellers(items, sellers), "order_id", "left")
    return fulfillment_heads(with_seller, customers, reviews).select(
        "order_id",
        "customer_unique_id",
        "customer_city",
        "customer_state",
        "seller_id",
        "seller_city",
        "seller_state",
        "order_status",
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        "delivery_days_actual",
        "delivery_days_estimated",
        "processing_days",
        "is_late_delivery",
        "review_score",
    )


def order_totals(items: DataFrame) -> DataFrame:
    """Items and their value per order."""
    value = F.col("price") + F.col("freight_value")
    return items.groupBy("order_id").agg(
        F.count("*").alias("n_items"), F.sum(value).alias("value_sum"), F.count(value).alias("value_count")
    )


def mart_customer_behavior(customers: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per buyer with at least one item."""
    bought = (
        orders.select("order_id", "customer_id", "order_purchase_timestamp")
        .join(order_totals(items), "order_id")
        .join(
            customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state"), "customer_id"
        )
    )
    # One row per order here, so counting rows counts distinct orders.
    per_buyer = bought.groupBy("customer_unique_id").agg(
        F.max("customer_city").alias("customer_city"),
        F.max("customer_state").alias("customer_state"),
        F.min("order_purchase_timestamp").alias("first_purchase_at"),
        F.max("order_purchase_timestamp").alias("latest_purchase_at"),
        F.count("*").alias("total_orders"),
        F.sum("n_items").alias("total_items_bought"),
        F.sum("value_sum").alias("total_lifetime_value"),
        F.sum("value_count").alias("value_count"),
    )
    return per_buyer.select(
        "customer_unique_id",
        "customer_city",
        "customer_state",
        "first_purchase_at",
        "latest_purchase_at",
        "total_orders",
        "total_items_bought",
        "total_lifetime_value",
        exact_avg("total_lifetime_value", "value_count").alias("avg_order_value"),
        (F.col("total_orders") > 1).alias("is_repeat_customer"),
    )


def mart_monthly_performance(sales: DataFrame) -> DataFrame:
    """One row per purchase month, from the sales fact (or anything with its five columns), all statuses."""
    value = F.col("price") + F.col("freight_value")
    per_order = sales.groupBy("order_purchase_timestamp", "customer_id", "order_id").agg(
        F.sum(value).alias("value_sum"), F.count(value).alias("value_count")
    )
    return _months(per_order)


def mart_monthly_from_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """The same mart without a sales fact: items are summed per order before they meet their order."""
    heads = orders.select("order_id", "customer_id", "order_purchase_timestamp")
    return _months(order_totals(items).join(heads, "order_id"))


def _months(per_order: DataFrame) -> DataFrame:
    """Months from one row per order, in two steps of ever fewer rows (buyer and month, month).

    Two COUNT DISTINCTs would make Spark copy every row once per distinct column before the shuffle.
    """
    per_customer = per_order.groupBy(
        month_bucket("order_purchase_timestamp").alias("month_start_date"), "customer_id"
    ).agg(
        F.sum("value_sum").alias("value_sum"),
        F.sum("value_count").alias("value_count"),
        F.count("order_id").alias("n_orders"),
    )
    per_month = per_customer.groupBy("month_start_date").agg(
        F.sum("value_sum").alias("total_revenue"),
        F.sum("n_orders").alias("total_orders"),
        F.count("customer_id").alias("total_customers"),
        F.sum("value_count").alias("value_count"),
    )
    return per_month.select(
        "month_start_date",
        "total_revenue",
        "total_orders",
        "total_customers",
        exact_avg("total_revenue", "value_count").alias("avg_order_value"),
    )


def _order_outcomes(orders: DataFrame) -> DataFrame:
    """Per order: is it delivered, and was a delivery that has both dates late?"""
    delivered_at, estimated = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    is_delivered = F.col("order_status") == DELIVERED
    timed = is_delivered & delivered_at.isNotNull() & estimated.isNotNull()
    return orders.select(
        "order_id",
        F.coalesce(is_delivered, F.lit(False)).alias("is_delivered"),
        F.when(timed, delivered_at > estimated).alias("late"),
        "order_purchase_timestamp",
    )


def mart_seller_performance(sellers: DataFrame, items: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per seller: delivered revenue and orders, review mean, late share.

    The review mean counts a review once per item of its order. Summing (items x score sum) and
    (items x score count) per order gives that without ever building the item-review pairs.
    """
    per_order = items.groupBy("order_id", "seller_id").agg(
        F.count("*").alias("n_items"), F.sum("price").alias("price_sum"), F.count("price").alias("price_count")
    )
    known = per_order.join(_order_outcomes(orders), "order_id", "left").join(order_scores(reviews), "order_id", "left")
    sold = F.col("is_delivered")
    metrics = known.groupBy("seller_id").agg(
        F.sum(F.when(sold, F.col("price_sum"))).alias("revenue"),
        F.count_if(sold).alias("orders"),
        F.sum(F.when(sold, F.col("n_items"))).alias("items_sold"),
        F.sum(F.when(sold, F.col("price_count"))).alias("price_count"),
        F.sum(F.col("n_items") * F.col("score_sum")).alias("score_sum"),
        F.sum(F.col("n_items") * F.col("score_count")).alias("score_count"),
        F.sum(F.when(F.col("late"), F.col("n_items"))).alias("late_items"),
        F.sum(F.when(F.col("late").isNotNull(), F.col("n_items"))).alias("timed_items"),
        F.min(F.when(sold, F.col("order_purchase_timestamp"))).alias("active_since"),
    )
    late_share = exact_avg(F.coalesce("late_items", F.lit(0)), "timed_items")
    return (
        sellers.select("seller_id", "seller_city", "seller_state")
        .join(metrics, "seller_id", "left")
        .select(
            "seller_id",
            "seller_city",
            "seller_state",
            F.coalesce("revenue", F.lit(0)).alias("total_revenue"),
            F.coalesce("orders", F.lit(0)).cast("long").alias("total_orders"),
            F.coalesce("items_sold", F.lit(0)).cast("long").alias("total_items_sold"),
            F.coalesce(exact_avg("revenue", "price_count"), F.lit(0.0)).alias("avg_item_price"),
            F.coalesce(exact_avg("score_sum", "score_count"), F.lit(0.0)).alias("avg_review_score"),
            F.coalesce(late_share, F.lit(0.0)).alias("late_delivery_rate"),
            "active_since",
        )
    )


def mart_product_performance(
    products: DataFrame, items: DataFrame, orders: DataFrame, reviews: DataFrame
) -> DataFrame:
    """One row per product: delivered revenue and units, review mean (weighted as for sellers)."""
    per_order = items.groupBy("order_id", "product_id").agg(
        F.count("*").alias("n_items"), F.sum("price").alias("price_sum"), F.count("price").alias("price_count")
    )
    status = orders.select("order_id", (F.col("order_status") == DELIVERED).alias("is_delivered"))
    known = per_order.join(status, "order_id", "left").join(order_scores(reviews), "order_id", "left")
    sold = F.col("is_delivered")
    metrics = known.groupBy("product_id").agg(
        F.sum(F.when(sold, F.col("price_sum"))).alias("revenue"),
        F.sum(F.when(sold, F.col("n_items"))).alias("units"),
        F.sum(F.when(sold, F.col("price_count"))).alias("price_count"),
        F.sum(F.col("n_items") * F.col("score_sum")).alias("score_sum"),
        F.sum(F.col("n_items") * F.col("score_count")).alias("score_count"),
    )
    return (
        products.select("product_id", "product_category_name", "product_photos_qty", "product_weight_g")
        .join(metrics, "product_id", "left")
        .select(
            "product_id",
            "product_category_name",
            F.coalesce("revenue", F.lit(0)).alias("total_revenue"),
            F.coalesce("units", F.lit(0)).cast("long").alias("total_units_sold"),
            F.coalesce(exact_avg("revenue", "price_count"), F.lit(0.0)).alias("avg_price"),
            F.coalesce(exact_avg("score_sum", "score_count"), F.lit(0.0)).alias("avg_review_score"),
            F.col("product_photos_qty").alias("total_photos"),
            "product_weight_g",
        )
    )
