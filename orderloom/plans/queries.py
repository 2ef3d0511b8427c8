"""Business questions on the gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderloom.functions import exact_avg, month_bucket, safe_divide, safe_growth
from orderloom.operators.results import top_k


def total_revenue(sales: DataFrame) -> DataFrame:
    return sales.agg(F.sum(F.col("price") + F.col("freight_value")).alias("total_revenue"))


def category_volume(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_category_name").agg(F.count("*").alias("sales_volume"))


def top_category(sales: DataFrame, k: int = 1) -> DataFrame:
    """Categories with the most items sold."""
    return top_k(category_volume(sales), "sales_volume", k, ["product_category_name"])


def top_states(customer_mart: DataFrame, k: int = 7) -> DataFrame:
    """States with the most buyers; the mart has one row per buyer."""
    counted = customer_mart.groupBy("customer_state").agg(F.count("customer_unique_id").alias("customer_count"))
    return top_k(counted, "customer_count", k, ["customer_state"])


def category_revenue(sales: DataFrame, k: int = 10) -> DataFrame:
    revenue = sales.groupBy("product_category_name").agg(F.sum("total_value").alias("revenue"))
    return top_k(revenue, "revenue", k, ["product_category_name"])


def revenue_trend(monthly: DataFrame) -> DataFrame:
    """Monthly revenue with growth over the month before in the table.

    The window has no partition key, which is fine here alone: the monthly mart has one row per month.
    """
    previous = F.lag("total_revenue").over(W.orderBy("month_start_date"))
    return monthly.select(
        "month_start_date",
        "total_revenue",
        previous.alias("previous_revenue"),
        safe_growth("total_revenue", previous).alias("growth_rate"),
    )


def delivery_delays(fulfillment: DataFrame) -> DataFrame:
    """Per customer state and purchase month: deliveries, late share, mean days and mean days over the estimate."""
    arrived = F.col("delivery_days_actual").isNotNull()
    over = F.col("delivery_days_actual") - F.col("delivery_days_estimated")
    grouped = fulfillment.groupBy(
        "customer_state", month_bucket("order_purchase_timestamp").alias("purchase_month")
    ).agg(
        F.count("*").alias("orders"),
        F.count_if(arrived).alias("deliveries"),
        F.count_if(F.col("is_late_delivery")).alias("late_deliveries"),
        F.sum("delivery_days_actual").alias("days"),
        F.sum(over).alias("days_over"),
        F.count(over).alias("n_over"),
    )
    return grouped.select(
        "customer_state",
        "purchase_month",
        "orders",
        "deliveries",
        "late_deliveries",
        safe_divide("late_deliveries", "deliveries").alias("late_rate"),
        exact_avg("days", "deliveries").alias("avg_delivery_days"),
        exact_avg("days_over", "n_over").alias("avg_days_over_estimate"),
    )


def review_by_state(fulfillment: DataFrame) -> DataFrame:
    grouped = fulfillment.groupBy("customer_state").agg(
        F.sum("review_score").alias("score_sum"), F.count("review_score").alias("reviewed_orders")
    )
    return grouped.select(
        "customer_state", exact_avg("score_sum", "reviewed_orders").alias("avg_review_score"), "reviewed_orders"
    )
