"""Tables of the warehouse: columns, types, keys and the columns a re-run may change."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
MEASURE = "decimal(18,4)"
TS = "timestamp_ntz"
UPDATED_AT = "_last_updated_at"
BRONZE_AUDIT = ("_ingested_at", "_source_file", "_source_checksum", "_ingestion_run_id")

LAYERS = ("reference", "bronze", "master", "silver", "gold", "ops")


@dataclass(frozen=True)
class TableSpec:
    """A typed table.

    ``kept``: columns that keep their first value when a row is merged again. ``sorted_by``: order of the rows
    inside each written file, so that a filter on these columns skips row groups by their minimum and maximum.
    ``by_month``: the timestamp by whose month the table is kept, so that a merge writes only the months it changes.
    """

    layer: str
    name: str
    keys: tuple[str, ...]
    columns: dict[str, str]
    kept: tuple[str, ...] = ()
    sorted_by: tuple[str, ...] = ()
    by_month: str | None = None
    comments: dict[str, str] = field(default_factory=dict)

    @property
    def update_cols(self) -> list[str]:
        return [c for c in self.columns if c not in self.keys and c not in self.kept]

    def conform(self, df: DataFrame) -> DataFrame:
        """The declared columns, in order, with the declared types and comments; a missing column is an error."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"{self.layer}.{self.name} lacks {missing}")
        return df.select(
            *[
                F.col(c).cast(t).alias(c, metadata={"comment": self.comments[c]})
                if c in self.comments
                else F.col(c).cast(t).alias(c)
                for c, t in self.columns.items()
            ]
        )


GEOGRAPHY = TableSpec(
    "master",
    "geography",
    ("city", "state"),
    {"city": "string", "state": "string", "avg_lat": "double", "avg_lng": "double"},
)
CUSTOMERS = TableSpec(
    "silver",
    "customers",
    ("customer_id",),
    {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_zip_code_prefix": "int",
        "customer_city": "string",
        "customer_state": "string",
    },
    comments={"customer_unique_id": "The buyer; one buyer may have several customer_id values."},
)
PRODUCTS = TableSpec(
    "silver",
    "products",
    ("product_id",),
    {
        "product_id": "string",
        "product_category_name": "string",
        "product_name_length": "int",
        "product_description_length": "int",
        "product_photos_qty": "int",
        "product_weight_g": MEASURE,
        "product_length_cm": MEASURE,
        "product_height_cm": MEASURE,
        "product_width_cm": MEASURE,
    },
)
SELLERS = TableSpec(
    "silver",
    "sellers",
    ("seller_id",),
    {"seller_id": "string", "seller_zip_code_prefix": "int", "seller_city": "string", "seller_state": "string"},
)
ORDERS = TableSpec(
    "silver",
    "orders",
    ("order_id",),
    {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": TS,
        "order_approved_at": TS,
        "order_delivered_carrier_date": TS,
        "order_delivered_customer_date": TS,
        "order_estimated_delivery_date": TS,
    },
    sorted_by=("order_purchase_timestamp",),
    by_month="order_purchase_timestamp",
    comments={"order_status": "created, approved, invoiced, processing, shipped, delivered, unavailable or canceled."},
)
ORDER_ITEMS = TableSpec(
    "silver",
    "order_items",
    ("order_id", "order_item_id"),
    {
        "order_id": "string",
        "order_item_id": "int",
        "product_id": "string",
        "seller_id": "string",
        "shipping_limit_date": TS,
        "price": MONEY,
        "freight_value": MONEY,
    },
)
ORDER_PAYMENTS = TableSpec(
    "silver",
    "order_payments",
    ("order_id", "payment_sequential"),
    {
        "order_id": "string",
        "payment_sequential": "int",
        "payment_type": "string",
        "payment_installments": "int",
        "payment_value": MONEY,
    },
)
ORDER_REVIEWS = TableSpec(
    "silver",
    "order_reviews",
    ("review_id", "order_id"),
    {
        "review_id": "string",
        "order_id": "string",
        "review_score": "int",
        "review_comment_title": "string",
        "review_comment_message": "string",
        "review_creation_date": TS,
        "review_answer_timestamp": TS,
    },
)
FACT_SALES_ITEMS = TableSpec(
    "gold",
    "fact_sales_items",
    ("order_item_key",),
    {
        "order_item_key": "string",
        "order_id": "string",
        "order_status": "string",
        "order_purchase_timestamp": TS,
        "product_id": "string",
        "product_category_name": "string",
        "product_weight_g": MEASURE,
        "product_length_cm": MEASURE,
        "product_height_cm": MEASURE,
        "product_width_cm": MEASURE,
        "seller_id": "string",
        "seller_city": "string",
        "seller_state": "string",
        "customer_id": "string",
        "customer_city": "string",
        "customer_state": "string",
        "payment_type": "string",
        "payment_installments": "int",
        "price": MONEY,
        "freight_value": MONEY,
        "total_value": MONEY,
    },
    kept=("order_id", "product_id", "seller_id", "seller_state", "customer_id", "customer_state"),
    sorted_by=("order_purchase_timestamp",),
    by_month="order_purchase_timestamp",
    comments={
        "order_item_key": "order_id-order_item_id.",
        "payment_type": "Type of the order's largest payment.",
        "total_value": "price + freight_value.",
    },
)
FACT_ORDER_FULFILLMENT = TableSpec(
    "gold",
    "fact_order_fulfillment",
    ("order_id",),
    {
        "order_id": "string",
        "customer_unique_id": "string",
        "customer_city": "string",
        "customer_state": "string",
        "seller_id": "string",
        "seller_city": "string",
        "seller_state": "string",
        "order_status": "string",
        "order_purchase_timestamp": TS,
        "order_approved_at": TS,
        "order_delivered_carrier_date": TS,
        "order_delivered_customer_date": TS,
        "order_estimated_delivery_date": TS,
        "delivery_days_actual": "int",
        "delivery_days_estimated": "int",
        "processing_days": "int",
        "is_late_delivery": "boolean",
        "review_score": "int",
    },
    kept=(
        "customer_unique_id",
        "customer_city",
        "customer_state",
        "seller_id",
        "seller_city",
        "seller_state",
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_estimated_delivery_date",
        "delivery_days_actual",
        "delivery_days_estimated",
        "processing_days",
    ),
    sorted_by=("order_purchase_timestamp",),
    by_month="order_purchase_timestamp",
    comments={"seller_id": "Seller of the order's most expensive item.", "review_score": "Rounded mean of 1 to 5."},
)
MART_CUSTOMER = TableSpec(
    "gold",
    "mart_customer_behavior",
    ("customer_unique_id",),
    {
        "customer_unique_id": "string",
        "customer_city": "string",
        "customer_state": "string",
        "first_purchase_at": TS,
        "latest_purchase_at": TS,
        "total_orders": "bigint",
        "total_items_bought": "bigint",
        "total_lifetime_value": "decimal(28,4)",
        "avg_order_value": "double",
        "is_repeat_customer": "boolean",
    },
    kept=("customer_city", "customer_state", "first_purchase_at", "total_items_bought", "avg_order_value"),
    comments={"customer_city": "Alphabetically last city of the buyer.", "avg_order_value": "Mean value of an item."},
)
MART_MONTHLY = TableSpec(
    "gold",
    "mart_monthly_performance",
    ("month_start_date",),
    {
        "month_start_date": "date",
        "total_revenue": "decimal(28,4)",
        "total_orders": "bigint",
        "total_customers": "bigint",
        "avg_order_value": "double",
    },
    kept=("avg_order_value",),
    comments={"total_orders": "Orders of any status.", "avg_order_value": "Mean value of an item."},
)
MART_SELLER = TableSpec(
    "gold",
    "mart_seller_performance",
    ("seller_id",),
    {
        "seller_id": "string",
        "seller_city": "string",
        "seller_state": "string",
        "total_revenue": "decimal(28,4)",
        "total_orders": "bigint",
        "total_items_sold": "bigint",
        "avg_item_price": "double",
        "avg_review_score": "double",
        "late_delivery_rate": "double",
        "active_since": TS,
    },
    kept=("seller_city", "seller_state", "avg_item_price", "active_since"),
    comments={"late_delivery_rate": "Share of delivered items, 0 to 1.", "total_revenue": "Delivered, without freight."},
)
MART_PRODUCT = TableSpec(
    "gold",
    "mart_product_performance",
    ("product_id",),
    {
        "product_id": "string",
        "product_category_name": "string",
        "total_revenue": "decimal(28,4)",
        "total_units_sold": "bigint",
        "avg_price": "double",
        "avg_review_score": "double",
        "total_photos": "int",
        "product_weight_g": MEASURE,
    },
    kept=("product_category_name", "avg_price", "total_photos", "product_weight_g"),
    comments={"total_revenue": "Delivered, without freight."},
)

# Build order: a model only reads tables that come before it.
MODELS = (
    GEOGRAPHY,
    CUSTOMERS,
    PRODUCTS,
    SELLERS,
    ORDERS,
    ORDER_ITEMS,
    ORDER_PAYMENTS,
    ORDER_REVIEWS,
    FACT_SALES_ITEMS,
    FACT_ORDER_FULFILLMENT,
    MART_CUSTOMER,
    MART_MONTHLY,
    MART_SELLER,
    MART_PRODUCT,
)

# Row counts of the public e-commerce data set.
EXPECTATIONS_VERSION = "1.1.0"
EXPECTED_ROWS = {
    "geography_master": 6333,
    "product_category_mapping": 73,
    "customers": 99441,
    "geolocation": 1000163,
    "orders": 99441,
    "order_items": 112650,
    "order_payments": 103886,
    "order_reviews": 99224,
    "products": 32951,
    "sellers": 3095,
    "product_category_name_translation": 71,
}
EXPECTED_ORDERS_PER_YEAR = {2016: 329, 2017: 45101, 2018: 54011}
