"""The generic star-schema tables seen as the warehouse's tables.

``Silver`` gives typed silver tables; ``bronze_*`` give the same content the way a landing CSV holds it, all
text, with stray blanks and mixed case, for the cleaning models.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.operators.dedupe import dedupe_first

ESTIMATED_DAYS = 90
STATUS_NAMES = {"F": "delivered", "O": "shipped", "P": "processing"}


def _status(code: Column) -> Column:
    named = F.lit(None).cast("string")
    for letter, name in STATUS_NAMES.items():
        named = F.when(code == letter, F.lit(name)).otherwise(named)
    return named


class Silver:
    """Silver tables over ``{folder}/{table}.parquet``. Everything is lazy; nothing is kept in memory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        """Nation with its region."""
        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state"))
        )

    @cached_property
    def customers(self) -> DataFrame:
        c = self.raw("customer").join(self.places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        return c.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
            F.col("city").alias("customer_city"),
            F.col("state").alias("customer_state"),
        )

    @cached_property
    def sellers(self) -> DataFrame:
        s = self.raw("supplier").join(self.places, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        return s.select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").alias("seller_zip_code_prefix"),
            F.col("city").alias("seller_city"),
            F.col("state").alias("seller_state"),
        )

    @cached_property
    def products(self) -> DataFrame:
        size = F.col("p_size").cast("decimal(18,4)")
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("product_category_name"),
            F.length("p_name").alias("product_name_length"),
            F.length("p_brand").alias("product_description_length"),
            F.col("p_size").alias("product_photos_qty"),
            size.alias("product_weight_g"),
            size.alias("product_length_cm"),
            size.alias("product_height_cm"),
            size.alias("product_width_cm"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        ships = (
            self.raw("lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
        )
        placed = F.col("o_orderdate")
        return (
            self.raw("orders")
            .join(ships, "o_orderkey", "left")
            .select(
                F.col("o_orderkey").alias("order_id"),
                F.col("o_custkey").alias("customer_id"),
                _status(F.col("o_orderstatus")).alias("order_status"),
                placed.alias("order_purchase_timestamp"),
                (placed + F.expr("interval 1 day")).alias("order_approved_at"),
                F.col("first_ship").alias("order_delivered_carrier_date"),
                F.col("last_ship").alias("order_delivered_customer_date"),
                (placed + F.expr(f"interval {ESTIMATED_DAYS} day")).alias("order_estimated_delivery_date"),
            )
        )

    @cached_property
    def order_heads(self) -> DataFrame:
        """Orders without the shipping dates, so without a scan of the line items."""
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            _status(F.col("o_orderstatus")).alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """One line item per (order, line number): the dearest, then the lowest part and supplier."""
        return dedupe_first(
            self.raw("lineitem"),
            ["l_orderkey", "l_linenumber"],
            [
                F.col("l_extendedprice").desc_nulls_last(),
                F.col("l_partkey").asc_nulls_last(),
                F.col("l_suppkey").asc_nulls_last(),
                F.col("l_shipdate").asc_nulls_last(),
                F.col("l_quantity").asc_nulls_last(),
                F.col("l_tax").asc_nulls_last(),
                F.col("l_returnflag").asc_nulls_last(),
            ],
        )

    @cached_property
    def order_items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        freight = price.cast("decimal(12,2)") * F.col("l_tax").cast("decimal(4,2)")
        return self.lines.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            price.cast("decimal(18,4)").alias("price"),
            freight.cast("decimal(18,4)").alias("freight_value"),
        )

    @cached_property
    def order_payments(self) -> DataFrame:
        return self.lines.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("payment_sequential"),
            F.col("l_returnflag").alias("payment_type"),
            F.col("l_quantity").cast("int").alias("payment_installments"),
            F.col("l_extendedprice").cast("decimal(18,4)").alias("payment_value"),
        )

    @cached_property
    def order_reviews(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("review_id"),
            F.col("o_orderkey").alias("order_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("review_score"),
        )


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), c.cast("string"), F.lit("  "))


def _stamp(c: Column) -> Column:
    return c.cast("string")


def bronze_customers(s: Silver) -> DataFrame:
    return s.customers.select(
        _padded(F.col("customer_id")).alias("customer_id"),
        _padded(F.col("customer_unique_id")).alias("customer_unique_id"),
        F.col("customer_zip_code_prefix").cast("string").alias("customer_zip_code_prefix"),
        _padded(F.lower("customer_city")).alias("customer_city"),
        F.lower("customer_state").alias("customer_state"),
    )


def bronze_sellers(s: Silver) -> DataFrame:
    return s.sellers.select(
        _padded(F.col("seller_id")).alias("seller_id"),
        F.col("seller_zip_code_prefix").cast("string").alias("seller_zip_code_prefix"),
        _padded(F.lower("seller_city")).alias("seller_city"),
        F.lower("seller_state").alias("seller_state"),
    )


def bronze_products(s: Silver) -> DataFrame:
    return s.products.select(
        _padded(F.col("product_id")).alias("product_id"),
        _padded(F.col("product_category_name")).alias("product_category_name"),
        F.concat(F.col("product_name_length").cast("string"), F.lit(".0")).alias("product_name_lenght"),
        F.concat(F.col("product_description_length").cast("string"), F.lit(".5")).alias("product_description_lenght"),
        F.concat(F.col("product_photos_qty").cast("string"), F.lit(".0")).alias("product_photos_qty"),
        *[
            F.col(c).cast("string").alias(c)
            for c in ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
        ],
    )


def bronze_orders(s: Silver) -> DataFrame:
    stamps = (
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )
    return s.orders.select(
        _padded(F.col("order_id")).alias("order_id"),
        _padded(F.col("customer_id")).alias("customer_id"),
        _padded(F.upper("order_status")).alias("order_status"),
        *[F.coalesce(_stamp(F.col(c)), F.lit(" ")).alias(c) for c in stamps],
    )


def bronze_order_items(s: Silver) -> DataFrame:
    return s.order_items.select(
        _padded(F.col("order_id")).alias("order_id"),
        F.concat(F.col("order_item_id").cast("string"), F.lit(".0")).alias("order_item_id"),
        F.col("product_id").cast("string").alias("product_id"),
        F.col("seller_id").cast("string").alias("seller_id"),
        _stamp(F.col("shipping_limit_date")).alias("shipping_limit_date"),
        _padded(F.col("price")).alias("price"),
        F.col("freight_value").cast("string").alias("freight_value"),
    )


def bronze_order_payments(s: Silver) -> DataFrame:
    return s.order_payments.select(
        _padded(F.col("order_id")).alias("order_id"),
        F.col("payment_sequential").cast("string").alias("payment_sequential"),
        _padded(F.col("payment_type")).alias("payment_type"),
        F.concat(F.col("payment_installments").cast("string"), F.lit(".0")).alias("payment_installments"),
        F.col("payment_value").cast("string").alias("payment_value"),
    )


def bronze_order_reviews(s: Silver) -> DataFrame:
    """Titles are the order priorities, and the message breaks the line the way free text does."""
    priority = F.col("o_orderpriority")
    return s.raw("orders").select(
        _padded(F.col("o_orderkey")).alias("review_id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.concat(F.substring(priority, 1, 1), F.lit(".0")).alias("review_score"),
        F.when(F.col("o_orderstatus") != "P", _padded(priority)).otherwise(F.lit("  ")).alias("review_comment_title"),
        F.concat(F.lit('said "'), priority, F.lit('",\nstatus '), F.col("o_orderstatus")).alias(
            "review_comment_message"
        ),
        _stamp(F.col("o_orderdate")).alias("review_creation_date"),
        F.lit("").alias("review_answer_timestamp"),
    )


def bronze_geolocation(s: Silver) -> DataFrame:
    """Places of the customers, spelt as a raw gazetteer spells them; the account balance serves as coordinate."""
    c = s.raw("customer").join(s.places, F.col("c_nationkey") == F.col("n_nationkey"))
    hundredth = (F.col("c_acctbal").cast("decimal(12,2)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(14,4)")
    return c.select(
        F.col("c_nationkey").cast("string").alias("geolocation_zip_code_prefix"),
        _padded(hundredth).alias("geolocation_lat"),
        (-hundredth).cast("string").alias("geolocation_lng"),
        F.concat(F.lit(" São "), F.upper("city"), F.lit(" - "), F.col("c_mktsegment")).alias("geolocation_city"),
        F.concat(F.lower("state"), F.lit(" ")).alias("geolocation_state"),
    )


def place_map(s: Silver) -> DataFrame:
    """raw_city, canonical_city, state for every region but ASIA, whose places keep their raw spelling."""
    known = s.places.filter(F.col("state") != "ASIA")
    return known.select(
        F.lower("city").alias("raw_city"),
        F.initcap(F.replace("city", F.lit("_"), F.lit(" "))).alias("canonical_city"),
        F.upper("state").alias("state"),
    )


def category_map(s: Silver) -> DataFrame:
    """raw_category, canonical_category for every product type but PROMO."""
    types = s.raw("part").select("p_type").distinct().filter(F.col("p_type") != "PROMO")
    return types.select(
        F.col("p_type").alias("raw_category"), F.concat(F.lower("p_type"), F.lit("_goods")).alias("canonical_category")
    )
