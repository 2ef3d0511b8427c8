"""Silver and master models: all-text landing rows in, typed rows out.

Every model takes landing tables whose columns are all text. ``strict=True`` fails on text that does not
parse, as the warehouse load does; ``strict=False`` turns it into NULL, and ``rejected_rows`` returns the
landing rows concerned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import (
    blank_to_null,
    clean_place,
    exact_avg,
    normalize_text,
    state_code,
    to_decimal,
    to_int,
    to_ts,
    trimmed,
)
from orderloom.operators.dedupe import dedupe_first

# Coordinates have up to fourteen decimals.
COORDINATE = (18, 14)


def _canonical_place(bronze: DataFrame, places: DataFrame, city: str, state: str) -> DataFrame:
    """Left join to the place map (raw_city, canonical_city, state); adds __city and __state."""
    known = places.select(
        F.col("raw_city").alias("__raw"),
        F.col("canonical_city").alias("__canonical"),
        F.col("state").alias("__map_state"),
    )
    same_place = (trimmed(city) == F.col("__raw")) & (state_code(state) == F.col("__map_state"))
    return bronze.join(known, same_place, "left").select(
        bronze["*"],
        F.coalesce(F.col("__canonical"), trimmed(city)).alias("__city"),
        F.coalesce(F.col("__map_state"), state_code(state)).alias("__state"),
    )


def geography(geolocation: DataFrame, strict: bool = True) -> DataFrame:
    """Mean coordinates per cleaned city and state."""
    cleaned = geolocation.select(
        clean_place("geolocation_city").alias("city"),
        state_code("geolocation_state").alias("state"),
        to_decimal("geolocation_lat", *COORDINATE, strict=strict).alias("lat"),
        to_decimal("geolocation_lng", *COORDINATE, strict=strict).alias("lng"),
    ).filter(F.col("city").isNotNull() & (F.col("city") != ""))
    sums = cleaned.groupBy("city", "state").agg(
        F.sum("lat").alias("lat"), F.count("lat").alias("n_lat"), F.sum("lng").alias("lng"), F.count("lng").alias("n_lng")
    )
    return sums.select(
        "city", "state", exact_avg("lat", "n_lat").alias("avg_lat"), exact_avg("lng", "n_lng").alias("avg_lng")
    )


def customers(bronze: DataFrame, places: DataFrame, strict: bool = True) -> DataFrame:
    """One row per customer_id: the one with the lowest buyer id (NULL last)."""
    placed = _canonical_place(bronze, places, "customer_city", "customer_state").select(
        blank_to_null("customer_id").alias("customer_id"),
        blank_to_null("customer_unique_id").alias("customer_unique_id"),
        to_int("customer_zip_code_prefix", strict, allow_fraction=False).alias("customer_zip_code_prefix"),
        F.col("__city").alias("customer_city"),
        F.col("__state").alias("customer_state"),
    )
    order = ["customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"]
    return dedupe_first(placed, ["customer_id"], [F.col(c).asc_nulls_last() for c in order])


def sellers(bronze: DataFrame, places: DataFrame, strict: bool = True) -> DataFrame:
    return _canonical_place(bronze, places, "seller_city", "seller_state").select(
        blank_to_null("seller_id").alias("seller_id"),
        to_int("seller_zip_code_prefix", strict, allow_fraction=False).alias("seller_zip_code_prefix"),
        F.col("__city").alias("seller_city"),
        F.col("__state").alias("seller_state"),
    )


def products(bronze: DataFrame, categories: DataFrame, strict: bool = True) -> DataFrame:
    known = categories.select(F.col("raw_category").alias("__raw"), F.col("canonical_category").alias("__category"))
    raw = trimmed("product_category_name")
    joined = bronze.join(known, raw == F.col("__raw"), "left")
    # The landing files spell "length" as "lenght" in two column names.
    return joined.select(
        blank_to_null("product_id").alias("product_id"),
        F.coalesce(F.col("__category"), raw).alias("product_category_name"),
        to_int("product_name_lenght", strict).alias("product_name_length"),
        to_int("product_description_lenght", strict).alias("product_description_length"),
        to_int("product_photos_qty", strict).alias("product_photos_qty"),
        *[
            to_decimal(c, strict=strict).alias(c)
            for c in ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
        ],
    )


def orders(bronze: DataFrame, strict: bool = True) -> DataFrame:
    stamps = (
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )
    return bronze.select(
        blank_to_null("order_id").alias("order_id"),
        blank_to_null("customer_id").alias("customer_id"),
        normalize_text("order_status").alias("order_status"),
        *[to_ts(c, strict=strict).alias(c) for c in stamps],
    )


def order_items(bronze: DataFrame, strict: bool = True) -> DataFrame:
    return bronze.select(
        blank_to_null("order_id").alias("order_id"),
        to_int("order_item_id", strict).alias("order_item_id"),
        blank_to_null("product_id").alias("product_id"),
        blank_to_null("seller_id").alias("seller_id"),
        to_ts("shipping_limit_date", strict=strict).alias("shipping_limit_date"),
        to_decimal("price", strict=strict).alias("price"),
        to_decimal("freight_value", strict=strict).alias("freight_value"),
    )


def order_payments(bronze: DataFrame, strict: bool = True) -> DataFrame:
    return bronze.select(
        blank_to_null("order_id").alias("order_id"),
        to_int("payment_sequential", strict).alias("payment_sequential"),
        normalize_text("payment_type").alias("payment_type"),
        to_int("payment_installments", strict).alias("payment_installments"),
        to_decimal("payment_value", strict=strict).alias("payment_value"),
    )


def order_reviews(bronze: DataFrame, strict: bool = True) -> DataFrame:
    return bronze.select(
        blank_to_null("review_id").alias("review_id"),
        blank_to_null("order_id").alias("order_id"),
        to_int("review_score", strict).alias("review_score"),
        blank_to_null("review_comment_title").alias("review_comment_title"),
        blank_to_null("review_comment_message").alias("review_comment_message"),
        to_ts("review_creation_date", strict=strict).alias("review_creation_date"),
        to_ts("review_answer_timestamp", strict=strict).alias("review_answer_timestamp"),
    )


def rejected_rows(bronze: DataFrame, parsers: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Landing rows with text that a lenient parser turned into NULL; ``bad_columns`` names the columns."""
    failed = F.array(
        *[F.when(blank_to_null(c).isNotNull() & parse(c).isNull(), F.lit(c)) for c, parse in parsers.items()]
    )
    return bronze.withColumn("bad_columns", F.array_compact(failed)).filter(F.size("bad_columns") > 0)
