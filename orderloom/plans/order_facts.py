"""Features around an order item and the marts over them.

The warehouse's documentation names these features without formulas; the definitions here are this
package's own and are stated with each function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import days_between, exact_avg, haversine_km, month_bucket, safe_divide
from orderloom.operators.dedupe import dedupe_first
from orderloom.operators.quality import union_all
from orderloom.operators.quantiles import global_rank
from orderloom.plans.gold import DELIVERED, fulfillment_heads, order_totals

# Fixed-date national holidays, month and day.
HOLIDAYS = ("01-01", "04-21", "05-01", "09-07", "10-12", "11-02", "11-15", "12-25")

# Highest score whose bound the value does not exceed (recency) or reaches (frequency, money); else 1.
RECENCY_DAYS = ((5, 30), (4, 90), (3, 180), (2, 365))
FREQUENCY_ORDERS = ((5, 10), (4, 5), (3, 3), (2, 2))
MONETARY_VALUE = ((5, 1000), (4, 500), (3, 200), (2, 100))


def logistics(orders: DataFrame) -> DataFrame:
    """Per order: delay against the estimate, handling (carrier to customer) and actual over promised days."""
    purchase, delivered = F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    estimated, carrier = F.col("order_estimated_delivery_date"), F.col("order_delivered_carrier_date")
    return orders.select(
        "order_id",
        days_between(delivered, purchase).alias("delivery_days"),
        days_between(delivered, estimated).alias("delivery_delay_days"),
        days_between(carrier, "order_approved_at").alias("processing_days"),
        days_between(delivered, carrier).alias("handling_days"),
        safe_divide(days_between(delivered, purchase), days_between(estimated, purchase)).alias("delivery_efficiency"),
        (delivered > estimated).alias("is_late_delivery"),
    )


def calendar(df: DataFrame, timestamp: str) -> DataFrame:
    """Year, month, day, weekday (Monday is 1), hour, weekend, holiday and southern season of a timestamp."""
    ts = F.col(timestamp)
    weekday = F.weekday(ts) + 1
    month = F.month(ts)
    season = (
        F.when(month.isin(12, 1, 2), "summer")
        .when(month.isin(3, 4, 5), "autumn")
        .when(month.isin(6, 7, 8), "winter")
        .when(month.isin(9, 10, 11), "spring")
    )
    return df.withColumns(
        {
            "purchase_year": F.year(ts),
            "purchase_month": month,
            "purchase_day": F.dayofmonth(ts),
            "purchase_weekday": weekday,
            "purchase_hour": F.hour(ts),
            "is_weekend": weekday >= 6,
            "is_holiday": F.date_format(ts, "MM-dd").isin(*HOLIDAYS),
            "purchase_season": season,
        }
    )


def _score(value: Column, bounds: tuple[tuple[int, int], ...], low_is_good: bool) -> Column:
    score = F.lit(1)
    for points, bound in reversed(bounds):
        score = F.when(value <= bound if low_is_good else value >= bound, F.lit(points)).otherwise(score)
    return F.when(value.isNotNull(), score)


def customer_features(customer_mart: DataFrame, as_of: str) -> DataFrame:
    """Per buyer: lifetime and recency in days as of a given time, orders per 30 days, and 1-5 scores."""
    now = F.lit(as_of).cast("timestamp_ntz")
    recency = days_between(now, "latest_purchase_at")
    lifetime = days_between("latest_purchase_at", "first_purchase_at")
    return customer_mart.select(
        "customer_unique_id",
        "total_orders",
        F.col("total_lifetime_value").alias("total_spent"),
        lifetime.alias("lifetime_days"),
        recency.alias("recency_days"),
        safe_divide(F.col("total_orders") * 30, lifetime).alias("orders_per_30_days"),
        _score(recency, RECENCY_DAYS, True).alias("recency_score"),
        _score(F.col("total_orders"), FREQUENCY_ORDERS, False).alias("frequency_score"),
        _score(F.col("total_lifetime_value"), MONETARY_VALUE, False).alias("monetary_score"),
    )


def seller_features(seller_mart: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """The seller mart's revenue, late rate and review mean with distinct customers and the rank by revenue."""
    per_order = items.groupBy("order_id", "seller_id").agg(F.lit(1).alias("one"))
    buyers = (
        per_order.join(orders.select("order_id", "customer_id"), "order_id")
        .groupBy("seller_id", "customer_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("seller_id")
        .agg(F.count("customer_id").alias("unique_customers"))
    )
    wanted = seller_mart.select("seller_id", "total_revenue", "late_delivery_rate", "avg_review_score")
    ranked = global_rank(wanted, "total_revenue", "revenue_rank")
    return ranked.join(buyers, "seller_id", "left").select(
        "seller_id",
        "total_revenue",
        "revenue_rank",
        F.coalesce("unique_customers", F.lit(0)).cast("long").alias("unique_customers"),
        "late_delivery_rate",
        "avg_review_score",
    )


def product_features(products: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per product: volume, density, mean freight, freight over price, and share of low reviews (1 or 2)."""
    low = reviews.groupBy("order_id").agg(
        F.count_if(F.col("review_score") <= 2).alias("low_reviews"), F.count("review_score").alias("n_reviews")
    )
    per_order = items.groupBy("order_id", "product_id").agg(
        F.sum("freight_value").alias("freight_sum"),
        F.count("freight_value").alias("freight_count"),
        F.sum("price").alias("price_sum"),
        F.count("*").alias("n_items"),
    )
    sums = (
        per_order.join(low, "order_id", "left")
        .groupBy("product_id")
        .agg(
            F.sum("freight_sum").alias("freight_sum"),
            F.sum("freight_count").alias("freight_count"),
            F.sum("price_sum").alias("price_sum"),
            F.sum(F.col("n_items") * F.col("low_reviews")).alias("low_reviews"),
            F.sum(F.col("n_items") * F.col("n_reviews")).alias("n_reviews"),
        )
    )
    volume = (
        F.col("product_length_cm").cast("double")
        * F.col("product_height_cm").cast("double")
        * F.col("product_width_cm").cast("double")
    )
    return products.join(sums, "product_id", "left").select(
        "product_id",
        volume.alias("volume_cm3"),
        safe_divide("product_weight_g", volume).alias("density_g_cm3"),
        exact_avg("freight_sum", "freight_count").alias("avg_shipping_cost"),
        safe_divide("freight_sum", "price_sum").alias("freight_ratio"),
        safe_divide("low_reviews", "n_reviews").alias("return_risk"),
    )


def payment_features(payments: DataFrame, items: DataFrame) -> DataFrame:
    """Per order: payments, kinds of payment, most installments, more than one payment, paid over ordered value."""
    per_kind = payments.groupBy("order_id", "payment_type").agg(
        F.count("*").alias("n"), F.max("payment_installments").alias("most"), F.sum("payment_value").alias("paid")
    )
    per_order = per_kind.groupBy("order_id").agg(
        F.sum("n").alias("payments"),
        F.count("payment_type").alias("payment_types"),
        F.max("most").alias("max_installments"),
        F.sum("paid").alias("paid"),
    )
    return per_order.join(order_totals(items), "order_id", "left").select(
        "order_id",
        "payments",
        "payment_types",
        "max_installments",
        (F.col("payments") > 1).alias("is_multi_payment"),
        safe_divide("paid", "value_sum").alias("payment_to_order_ratio"),
    )


def order_distances(sales: DataFrame, geography: DataFrame) -> DataFrame:
    """Per order item: kilometres between the buyer's and the seller's place, and whether the state is the same."""

    def end(side: str) -> DataFrame:
        return geography.select(
            F.col("city").alias(f"{side}_city"),
            F.col("state").alias(f"{side}_state"),
            F.col("avg_lat").alias(f"{side}_lat"),
            F.col("avg_lng").alias(f"{side}_lng"),
        )

    located = sales.join(end("customer"), ["customer_city", "customer_state"], "left").join(
        end("seller"), ["seller_city", "seller_state"], "left"
    )
    return located.select(
        "order_item_key",
        haversine_km("customer_lat", "customer_lng", "seller_lat", "seller_lng").alias("distance_km"),
        (F.col("customer_state") == F.col("seller_state")).alias("is_same_state"),
    )


def urban_places(geography: DataFrame, customers: DataFrame, cell_degrees: float, least: int) -> DataFrame:
    """Per place with coordinates: its grid cell, the places and customers around it, and whether that is urban.

    The proxy: coordinates fall into square cells of ``cell_degrees``; what counts are the customers of all places in
    the cell and the eight around it. A place is urban if they are ``least`` or more. Cells are counted before they
    are spread over their neighbours, so a crowded cell is nine rows.
    """
    living = customers.groupBy(F.col("customer_city").alias("city"), F.col("customer_state").alias("state")).agg(
        F.count("*").alias("n")
    )
    x, y = F.floor(F.col("avg_lng") / cell_degrees), F.floor(F.col("avg_lat") / cell_degrees)
    placed = geography.filter(F.col("avg_lat").isNotNull() & F.col("avg_lng").isNotNull()).select(
        "city", "state", x.alias("cell_x"), y.alias("cell_y")
    )
    cells = (
        placed.join(living, ["city", "state"], "left")
        .groupBy("cell_x", "cell_y")
        .agg(F.count("*").alias("places"), F.sum(F.coalesce("n", F.lit(0))).alias("customers"))
    )
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = (
        cells.withColumn("d", near)
        .groupBy((F.col("cell_x") + F.col("d.dx")).alias("cell_x"), (F.col("cell_y") + F.col("d.dy")).alias("cell_y"))
        .agg(F.sum("places").alias("places_near"), F.sum("customers").alias("customers_near"))
    )
    return placed.join(around, ["cell_x", "cell_y"]).select(
        "city", "state", "cell_x", "cell_y", "places_near", "customers_near", (F.col("customers_near") >= least).alias("is_urban")
    )


# --- marts over the sales and fulfillment facts --------------------------------------------------------------


def _sales_by(sales: DataFrame, key: Column | str) -> DataFrame:
    """Items, distinct orders, revenue and mean item value per key; items are summed per (key, order) first.

    There are about as many (key, order) as items, so no map of them is to be held: with a text among the measures
    Spark sorts the items by order, as they mostly are, and folds each order's rows as they come.
    """
    per_order = sales.groupBy("order_id", key).agg(
        F.max(F.col("order_id").cast("string")).alias("order_text"),
        F.count("*").alias("n_items"),
        F.sum("total_value").alias("value_sum"),
        F.count("total_value").alias("n_values"),
    )
    name = per_order.columns[1]
    grouped = per_order.groupBy(name).agg(
        F.count("order_text").alias("orders"),
        F.sum("n_items").alias("items"),
        F.sum("value_sum").alias("revenue"),
        F.sum("n_values").alias("n_values"),
    )
    return grouped.select(name, "orders", "items", "revenue", exact_avg("revenue", "n_values").alias("avg_item_value"))


def sales_summary(sales: DataFrame) -> DataFrame:
    return _sales_by(sales, month_bucket("order_purchase_timestamp").alias("month_start_date"))


def category_performance(sales: DataFrame) -> DataFrame:
    return _sales_by(sales, "product_category_name")


def state_performance(sales: DataFrame) -> DataFrame:
    return _sales_by(sales, "customer_state")


def payment_method_performance(sales: DataFrame) -> DataFrame:
    return _sales_by(sales, "payment_type")


def delivery_performance(orders: DataFrame, customers: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per customer state, delivered orders only: mean days, late share, mean review. The mean days double as the
    difficulty of the region."""
    heads = fulfillment_heads(orders.filter(F.col("order_status") == DELIVERED), customers, reviews)
    grouped = heads.groupBy("customer_state").agg(
        F.count("*").alias("orders"),
        F.count("delivery_days_actual").alias("timed"),
        F.sum("delivery_days_actual").alias("days"),
        F.count_if("is_late_delivery").alias("late"),
        F.sum("review_score").alias("score_sum"),
        F.count("review_score").alias("score_count"),
    )
    return grouped.select(
        "customer_state",
        "orders",
        exact_avg("days", "timed").alias("avg_delivery_days"),
        safe_divide("late", "timed").alias("late_rate"),
        exact_avg("score_sum", "score_count").alias("avg_review_score"),
    )


def zip_prefixes(geolocation: DataFrame) -> DataFrame:
    """One geolocation row per ZIP prefix: the first in order of state, city, latitude and longitude."""
    order = [
        F.col(f"geolocation_{c}").asc_nulls_last() for c in ("state", "city", "lat", "lng")
    ]
    return dedupe_first(geolocation, ["geolocation_zip_code_prefix"], order)


def quality_issues(orders: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    """Rows that break a rule: (issue_type, table_name, record_key)."""

    def issue(kind: str, table: str, rows: DataFrame, key: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("issue_type"), F.lit(table).alias("table_name"), key.alias("record_key"))

    key = F.col("order_id").cast("string")
    payment_key = F.concat_ws("-", "order_id", "payment_sequential")
    delivered, purchase = F.col("order_delivered_customer_date"), F.col("order_purchase_timestamp")
    repeated = orders.groupBy("order_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return union_all(
        [
            issue("missing_id", "orders", orders.filter(F.col("order_id").isNull()), F.lit(None).cast("string")),
            issue("duplicate_id", "orders", repeated, key),
            issue("unknown_customer", "orders", orders.join(customers, "customer_id", "left_anti"), key),
            issue("delivered_before_purchase", "orders", orders.filter(delivered < purchase), key),
            issue("negative_payment", "order_payments", payments.filter(F.col("payment_value") < 0), payment_key),
        ]
    )
