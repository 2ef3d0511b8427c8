"""The registered queries: every operator and model run over the whole star-schema tables.

Each query takes (spark, folder) and returns a lazy DataFrame, except the few whose point is writing
(landing, streaming, warehouse build): those write to the shared folder first and return what they wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom import schemas as S
from orderloom.functions import (
    absolute_gap,
    blank_to_null,
    clean_place,
    composite_key,
    days_between,
    normalize_text,
    safe_divide,
    safe_growth,
    seconds_between,
    state_code,
    surrogate_key,
    to_decimal,
    to_int,
    token_estimate,
)
from orderloom.operators import dedupe, lookup, merge, profile, quality, results
from orderloom.operators.quantiles import describe_values, global_rank
from orderloom.plans import build, checks, gold, silver
from orderloom.plans import order_facts as facts
from orderloom.plans import queries as business
from orderloom.sources import bronze, registry, runlog, standins
from orderloom.sources.standins import Silver
from orderloom.sources.store import TableStore, scratch_folder
from orderloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so that any client compares the values alike."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, folder: portable(fn(spark, folder))
    return fn


# --- gold models -----------------------------------------------------------------------------------------


@query
def fact_sales_items(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return gold.fact_sales_items(
        s.order_items, s.order_heads, s.products, s.sellers, s.customers, s.order_payments
    )


@query
def fact_order_fulfillment(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return gold.fact_order_fulfillment(s.orders, s.customers, s.order_reviews, s.order_items, s.sellers)


@query
def mart_customer_behavior(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return gold.mart_customer_behavior(s.customers, s.order_heads, s.order_items)


@query
def mart_monthly_performance(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return gold.mart_monthly_from_items(s.order_items, s.order_heads)


@query
def mart_monthly_from_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly mart as the warehouse build computes it, from the rows of the sales fact."""
    s = Silver(spark, folder)
    return gold.mart_monthly_performance(gold.sold_items(s.order_items, s.order_heads))


@query
def mart_seller_performance(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return gold.mart_seller_performance(s.sellers, s.order_items, s.orders, s.order_reviews)


@query
def mart_product_performance(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return gold.mart_product_performance(s.products, s.order_items, s.order_heads, s.order_reviews)


# --- silver and master models ------------------------------------------------------------------------------


@query
def master_geography(spark: SparkSession, folder: str) -> DataFrame:
    return silver.geography(standins.bronze_geolocation(Silver(spark, folder)))


@query
def silver_customers(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return silver.customers(standins.bronze_customers(s), standins.place_map(s))


@query
def silver_sellers(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return silver.sellers(standins.bronze_sellers(s), standins.place_map(s))


@query
def silver_products(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return silver.products(standins.bronze_products(s), standins.category_map(s))


@query
def silver_orders(spark: SparkSession, folder: str) -> DataFrame:
    return silver.orders(standins.bronze_orders(Silver(spark, folder)))


@query
def silver_order_items(spark: SparkSession, folder: str) -> DataFrame:
    return silver.order_items(standins.bronze_order_items(Silver(spark, folder)))


@query
def silver_order_payments(spark: SparkSession, folder: str) -> DataFrame:
    return silver.order_payments(standins.bronze_order_payments(Silver(spark, folder)))


@query
def silver_order_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return silver.order_reviews(standins.bronze_order_reviews(Silver(spark, folder)))


@query
def rejected_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order priorities read as whole numbers and some prices that are none: bad rows with the columns named."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = Silver(spark, folder).raw("orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.when(status == "P", F.col("o_orderpriority")).otherwise(F.substring("o_orderpriority", 1, 1)).alias(
            "payment_installments"
        ),
        F.when((status != "F") & (F.col("o_orderkey") % 2 == 0), "n/k")
        .when(F.col("o_orderkey") % 7 == 0, F.concat(price, F.lit("001")))
        .otherwise(price)
        .alias("price"),
    )
    bad = silver.rejected_rows(
        raw,
        {
            "payment_installments": lambda c: to_int(c, strict=False),
            "price": lambda c: to_decimal(c, strict=False),
        },
    )
    return bad.select("order_id", F.concat_ws(",", "bad_columns").alias("bad_columns"))


# --- merge and dedupe --------------------------------------------------------------------------------------


def _two_loads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders as of a first load (closed and open ones) and of a second (open and pending ones, later values)."""
    raw = Silver(spark, folder).raw("orders")
    columns = [
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_totalprice").alias("total_price"),
        F.col("o_orderpriority").alias("priority"),
    ]
    first = raw.filter(F.col("o_orderstatus") != "P").select(*columns)
    second = raw.filter(F.col("o_orderstatus") != "F").select(*columns)
    later = second.select(
        "order_id",
        (F.col("customer_id") + 1).alias("customer_id"),
        F.concat(F.lit("new "), "order_status").alias("order_status"),
        (F.col("total_price") * 2).alias("total_price"),
        F.concat(F.lit("new "), "priority").alias("priority"),
    )
    return first, later


@query
def merge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Only status and price follow the second load; customer and priority keep their first value."""
    first, later = _two_loads(spark, folder)
    return merge.merge_upsert(first, later, ["order_id"], ["order_status", "total_price"])


@query
def merge_upsert_all_columns(spark: SparkSession, folder: str) -> DataFrame:
    first, later = _two_loads(spark, folder)
    return merge.merge_upsert(first, later, ["order_id"])


@query
def refresh_monthly_mart(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly mart of delivered items, merged again with all items: the average keeps its first value."""
    s = Silver(spark, folder)
    spec = S.MART_MONTHLY
    delivered = s.order_heads.filter(F.col("order_status") == gold.DELIVERED)
    before = spec.conform(gold.mart_monthly_from_items(s.order_items, delivered))
    after = spec.conform(gold.mart_monthly_from_items(s.order_items, s.order_heads))
    return merge.merge_upsert(before, after, spec.keys, spec.update_cols, source_is_unique=True)


@query
def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    """One line item per order and line number."""
    return Silver(spark, folder).lines


@query
def primary_payments(spark: SparkSession, folder: str) -> DataFrame:
    return gold.primary_payments(Silver(spark, folder).order_payments)


@query
def primary_sellers(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return gold.primary_sellers(s.order_items, s.sellers)


@query
def lookup_names(spark: SparkSession, folder: str) -> DataFrame:
    """Nation code to name, with the code itself where the map has none: one region's codes differ there."""
    s = Silver(spark, folder)
    code = F.when(F.col("state") == "ASIA", F.col("n_nationkey") + 1000).otherwise(F.col("n_nationkey"))
    names = s.places.select(code.alias("code"), F.col("city").alias("name"))
    found = lookup.lookup(
        s.raw("customer"),
        names,
        {"code": F.col("c_nationkey")},
        "name",
        "nation_name",
        F.concat(F.lit("#"), F.col("c_nationkey").cast("string")),
    )
    return found.select("c_custkey", "nation_name")


@query
def customer_match_count(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose customer is on record; every tenth one names another."""
    s = Silver(spark, folder)
    orders = s.raw("orders").withColumn("o_custkey", _every_tenth_unknown("o_orderkey", "o_custkey"))
    return lookup.match_count(orders, "o_custkey", s.raw("customer"), "c_custkey")


# --- business questions ------------------------------------------------------------------------------------


def _sales_with_category(s: Silver) -> DataFrame:
    """Sold items with their category; the other columns of the sales fact are not needed here."""
    names = s.products.select("product_id", "product_category_name")
    return gold.sold_items(s.order_items, s.order_heads).join(names, "product_id", "left")


@query
def total_revenue(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return business.total_revenue(gold.sold_items(s.order_items, s.order_heads))


@query
def top_category(spark: SparkSession, folder: str) -> DataFrame:
    return business.top_category(_sales_with_category(Silver(spark, folder)))


@query
def top_categories_by_sales(spark: SparkSession, folder: str) -> DataFrame:
    return business.top_category(_sales_with_category(Silver(spark, folder)), 5)


@query
def category_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return business.category_revenue(_sales_with_category(Silver(spark, folder)))


@query
def top_states(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return business.top_states(gold.mart_customer_behavior(s.customers, s.order_heads, s.order_items))


@query
def monthly_growth(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return business.revenue_trend(gold.mart_monthly_from_items(s.order_items, s.order_heads))


@query
def delivery_delays(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return business.delivery_delays(gold.fulfillment_heads(s.orders, s.customers, s.order_reviews))


@query
def review_by_state(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return business.review_by_state(gold.fulfillment_heads(s.orders, s.customers, s.order_reviews))


# --- quality -----------------------------------------------------------------------------------------------


@query
def warehouse_checks(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return checks.warehouse_checks(
        s.order_heads, s.order_payments, s.order_items, gold.sold_items(s.order_items, s.order_heads)
    )


@query
def column_tests(spark: SparkSession, folder: str) -> DataFrame:
    """On the raw line items, whose line numbers repeat; every tenth order names a customer that is not there."""
    s = Silver(spark, folder)
    customers = s.raw("customer").select(F.col("c_custkey").alias("customer_id"))
    orders = s.order_heads.withColumn("customer_id", _every_tenth_unknown("order_id", "customer_id"))
    sales = s.raw("lineitem").select(composite_key("l_orderkey", "l_linenumber").alias("order_item_key"))
    return checks.column_tests(customers, orders, sales, "order_item_key")


def _every_tenth_unknown(key: str, parent: str) -> Column:
    return F.when(F.col(key) % 10 == 0, -F.col(parent) - 1).otherwise(F.col(parent))


@query
def row_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Several range checks over the line items in one scan."""
    return quality.check_rows(
        Silver(spark, folder).raw("lineitem"),
        "bronze",
        {
            "discount_above_five_percent": F.col("l_discount") > 0.05,
            "price_missing": F.col("l_extendedprice").isNull(),
            "quantity_not_positive": F.col("l_quantity") <= 0,
            "untaxed": F.col("l_tax") == 0,
        },
    )


@query
def issue_total(spark: SparkSession, folder: str) -> DataFrame:
    return quality.total_issues(column_tests(spark, folder))


@query
def row_count_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts of six tables against the expected counts of the public data set; one has none."""
    s = Silver(spark, folder)
    tables = {
        "customers": s.raw("customer"),
        "orders": s.raw("orders"),
        "order_items": s.raw("lineitem"),
        "products": s.raw("part"),
        "sellers": s.raw("supplier"),
        "events": s.raw("events"),
    }
    expected = quality.expectations_frame(spark, S.EXPECTED_ROWS, S.EXPECTATIONS_VERSION)
    return quality.check_row_count(tables, expected)


@query
def yearly_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = quality.yearly_counts(Silver(spark, folder).raw("orders"), "o_orderdate")
    return counted.select(F.col("year").cast("int").alias("year"), "actual")


@query
def yearly_count_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Expected: as many orders in each year as have that year as their last shipping year."""
    s = Silver(spark, folder)
    shipped = s.orders.groupBy(F.year("order_delivered_customer_date").alias("year")).agg(
        F.count("*").alias("row_count")
    )
    expected = shipped.filter(F.col("year").isNotNull()).select(F.lit("orders").alias("table_name"), "year", "row_count")
    return quality.check_yearly_counts(s.order_heads, "order_purchase_timestamp", "orders", expected)


@query
def growth_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Line items per ship year as the new snapshot, against those per order year; years before 2000 are kept."""
    s = Silver(spark, folder)
    items = s.raw("lineitem").select("l_orderkey", "l_shipdate")
    new = items.groupBy(F.year("l_shipdate").cast("string").alias("table_name")).agg(F.count("*").alias("actual"))
    per_order = items.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    ordered = s.raw("orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    expected = ordered.groupBy(F.year("o_orderdate").cast("string").alias("table_name")).agg(
        F.sum("n").alias("row_count")
    )
    kept = expected.filter(F.col("table_name") < "2000").select("table_name")
    return quality.growth_gate(new, expected, kept)


@query
def renew_expectations(spark: SparkSession, folder: str) -> DataFrame:
    """Expected rows per order status renewed from the statuses of orders that have shipped."""
    s = Silver(spark, folder)
    counted = s.order_heads.groupBy(F.col("order_status").alias("table_name")).agg(F.count("*").alias("row_count"))
    observed = (
        s.orders.filter(F.col("order_delivered_customer_date").isNotNull() & (F.col("order_status") != "shipped"))
        .groupBy(F.col("order_status").alias("table_name"))
        .agg(F.count("*").alias("actual"))
    )
    return quality.renew_expectations(counted.withColumn("version", F.lit("1.1.9")), observed)


# --- profiling ---------------------------------------------------------------------------------------------


@query
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return results.value_counts(Silver(spark, folder).raw("events"), "event_type")


@query
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_counts(
        Silver(spark, folder).raw("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
    )


@query
def approx_distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    raw = Silver(spark, folder).raw("lineitem")
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
    estimated = profile.approx_distinct_counts(raw, columns).withColumnRenamed("n_distinct", "approx_distinct")
    return _with_close_estimate(estimated, profile.distinct_counts(raw, columns))


@query
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of the orders; of the estimate, whether it is close to the exact number."""
    raw = Silver(spark, folder).raw("orders")
    return _with_close_estimate(profile.profile(raw), profile.distinct_counts(raw, raw.columns))


def _with_close_estimate(estimated: DataFrame, exact: DataFrame, column: str = "approx_distinct") -> DataFrame:
    """The estimate replaced by the exact number and whether the two differ by a tenth at most."""
    near = F.abs(F.col(column) - F.col("exact")) <= 0.1 * F.col("exact") + 1
    joined = estimated.join(exact.select("column_name", F.col("n_distinct").alias("exact")), "column_name")
    return joined.withColumn("estimate_is_close", near).drop(column).withColumnRenamed("exact", "n_distinct")


@query
def column_profile_documents(spark: SparkSession, folder: str) -> DataFrame:
    raw = Silver(spark, folder).raw("documents")
    return _with_close_estimate(profile.profile(raw), profile.distinct_counts(raw, raw.columns))


@query
def example_values(spark: SparkSession, folder: str) -> DataFrame:
    examples = profile.example_values(Silver(spark, folder).raw("part"), ["p_partkey"])
    return examples.select("column_name", F.concat_ws("|", "examples").alias("examples"))


@query
def sequence_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    raw = Silver(spark, folder).raw("lineitem")
    return profile.sequence_verdicts(raw, "l_orderkey", "l_linenumber").groupBy("is_contiguous").agg(
        F.count("*").alias("orders")
    )


@query
def sequence_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return profile.sequence_gaps(Silver(spark, folder).order_payments, "order_id", "payment_sequential")


@query
def repeated_payment_type(spark: SparkSession, folder: str) -> DataFrame:
    """All payments of the orders with more than one payment of type A."""
    payments = Silver(spark, folder).order_payments
    return profile.groups_with_repeats(payments, "order_id", F.col("payment_type") == "A")


@query
def order_violations(spark: SparkSession, folder: str) -> DataFrame:
    return profile.order_violations(Silver(spark, folder).orders, profile.date_order_rules())


@query
def interval_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Approval to carrier hand-over, where the hand-over came first; rounded, as the standard deviation is a float."""
    summary = profile.interval_summary(
        Silver(spark, folder).orders,
        seconds_between("order_approved_at", "order_delivered_carrier_date"),
        F.col("order_delivered_carrier_date") < F.col("order_approved_at"),
    )
    return summary.select("stat", F.round("value", 2).alias("value"))


@query
def event_value_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The same summary over the event values, whose quantiles fall between two values."""
    summary = describe_values(Silver(spark, folder).raw("events"), "value")
    return summary.select("stat", F.round("value", 6).alias("value"))


@query
def surplus_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items equal to an earlier one in order, line number and flags."""
    raw = Silver(spark, folder).raw("lineitem")
    return dedupe.surplus_row_count(raw.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"))


@query
def surplus_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose whole text and language occur already."""
    return dedupe.surplus_row_count(Silver(spark, folder).raw("documents").select("text", "lang"))


@query
def duplicated_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All line items that share their order and line number with another."""
    return profile.duplicates(Silver(spark, folder).raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query
def parse_report(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates as text; open orders have the date only, pending ones nothing but a dash."""
    stamp = F.col("o_orderdate").cast("string")
    status = F.col("o_orderstatus")
    text = Silver(spark, folder).raw("orders").select(
        stamp.alias("order_purchase_timestamp"),
        F.when(status == "F", stamp).when(status == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).alias(
            "order_approved_at"
        ),
        F.when(status == "P", F.lit("-")).otherwise(stamp).alias("order_estimated_delivery_date"),
    )
    return profile.parse_report(text, text.columns)


@query
def fuzzy_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return lookup.fuzzy_top_k(Silver(spark, folder).raw("part"), "p_name", "hot gear", 20)


# --- functions ---------------------------------------------------------------------------------------------


@query
def event_gap_days(spark: SparkSession, folder: str) -> DataFrame:
    """Whole days and microseconds since the user's first purchase, both ways round; NULL without a purchase."""
    events = Silver(spark, folder).raw("events")
    bought = (
        events.filter(F.col("event_type") == "purchase")
        .groupBy(F.col("user_id").alias("buyer"))
        .agg(F.min("ts").alias("bought_at"))
    )
    gaps = events.join(bought, F.col("user_id") == F.col("buyer"), "left")
    return gaps.select(
        "event_id",
        days_between("ts", "bought_at").alias("days_since"),
        days_between("bought_at", "ts").alias("days_until"),
        F.round(seconds_between("ts", "bought_at") * 1_000_000).cast("long").alias("us_since"),
    )


@query
def surrogate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return Silver(spark, folder).raw("orders").select(
        "o_orderkey",
        surrogate_key("o_orderkey", F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority").alias("order_sk"),
        composite_key("o_orderkey", F.nullif("o_orderstatus", F.lit("P"))).alias("order_text_key"),
    )


@query
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Trim, blank to NULL, lower and upper case over the whole document texts."""
    texts = Silver(spark, folder).raw("documents")
    padded = F.concat(F.lit("  "), F.col("text"), F.lit(" "))
    often_blank = F.concat(F.lit("  "), F.when(F.col("lang") == "es", F.lit("")).otherwise(F.col("lang")))
    return texts.select(
        "doc_id",
        F.md5(blank_to_null(padded)).alias("blank_to_null_md5"),
        F.md5(normalize_text(padded)).alias("normalized_md5"),
        blank_to_null(often_blank).alias("lang_or_null"),
        state_code("lang").alias("lang_code"),
    )


@query
def numeric_casts(spark: SparkSession, folder: str) -> DataFrame:
    """Text to integer through a decimal: halves round away from zero."""
    raw = Silver(spark, folder).raw("lineitem")
    halves = F.concat((F.col("l_linenumber") - 4).cast("string"), F.lit(".5"))
    return raw.groupBy(
        to_int(F.concat(F.lit(" "), F.col("l_quantity").cast("string"))).alias("quantity"),
        to_int(halves).alias("rounded_half"),
    ).agg(F.count("*").alias("n"), F.sum(to_decimal(F.col("l_tax").cast("string"), 18, 2)).alias("tax"))


@query
def safe_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    """Growth, ratio and distance where the divisor is often zero or missing."""
    raw = Silver(spark, folder).raw("lineitem")
    discount = F.when(F.col("l_linenumber") != 7, F.col("l_discount"))
    return raw.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(safe_growth("l_tax", discount)).alias("growth_known"),
        F.max(safe_growth("l_tax", discount)).alias("growth_max"),
        F.count(safe_divide("l_quantity", discount)).alias("ratio_known"),
        F.max(safe_divide("l_quantity", discount)).alias("ratio_max"),
        F.count_if(
            absolute_gap(F.col("l_tax").cast("decimal(4,2)"), discount.cast("decimal(4,2)")) < F.lit("0.01").cast("decimal(4,2)")
        ).alias("near"),
    )


@query
def place_names(spark: SparkSession, folder: str) -> DataFrame:
    """Place cleaning over the whole document texts (many accents, dashes and brackets)."""
    return Silver(spark, folder).raw("documents").select("doc_id", F.md5(clean_place("text")).alias("place_md5"))


@query
def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return Silver(spark, folder).raw("conversations").select("conv_id", "turn", token_estimate("text").alias("tokens"))


@query
def sanitized_values(spark: SparkSession, folder: str) -> DataFrame:
    """Event values with NaN for errors and an infinity for sign-ups; both come out as NULL."""
    value = (
        F.when(F.col("event_type") == "error", F.lit(float("nan")))
        .when(F.col("event_type") == "signup", F.lit(float("inf")))
        .when(F.col("event_type") == "view", F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    dirty = Silver(spark, folder).raw("events").select("event_id", value.alias("value"))
    return results.sanitize(dirty)


# --- result shaping and ad-hoc SQL --------------------------------------------------------------------------


@query
def pivot_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity by ship year (rows) and return flag (two columns and one for the others)."""
    raw = Silver(spark, folder).raw("lineitem").select(
        F.year("l_shipdate").cast("int").alias("ship_year"), "l_returnflag", "l_quantity"
    )
    return results.pivot_series(raw, "ship_year", "l_returnflag", "l_quantity", ["A", "R"])


@query
def multi_series(spark: SparkSession, folder: str) -> DataFrame:
    """Order value by priority and status: two categories and one number, so one row for each pair."""
    raw = Silver(spark, folder).raw("orders").select(
        "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total")
    )
    return results.series_totals(raw)


@query
def bounded_sql(spark: SparkSession, folder: str) -> DataFrame:
    """A free query over the sales fact whose text has a limit of its own."""
    return results.bounded_sql(
        spark,
        """
        SELECT customer_state, product_category_name, payment_type, count(*) AS items, sum(total_value) AS revenue
        FROM {sales}
        WHERE order_status = 'delivered'
        GROUP BY customer_state, product_category_name, payment_type
        ORDER BY revenue DESC, customer_state, product_category_name, payment_type
        LIMIT 150
        """,
        sales=fact_sales_items(spark, folder),
    )


@query
def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    return results.sample_rows(Silver(spark, folder).raw("customer"), ["c_custkey"])


@query
def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as the request log: the role stands for the status."""
    return runlog.request_log_summary(Silver(spark, folder).raw("conversations"), "role", token_estimate("text"))


@query
def latest_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as run events: a user is a run, a purchase or an error ends it."""
    events = Silver(spark, folder).raw("events").select("user_id", "ts", "event_id", "event_type", "value")
    return runlog.latest_runs(
        events, "user_id", "ts", "event_id", end=F.col("event_type").isin("purchase", "error")
    )


@query
def request_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Users' events as requests: from the first to the last event, by its type; mean and 95th percentile per type."""
    events = Silver(spark, folder).raw("events")
    ended = F.col("event_type").isNotNull()
    runs = runlog.request_durations(events, "user_id", "ts", "event_id", "event_type", ended)
    summary = runlog.request_log_summary(runs, "event_type", F.lit(1), F.col("duration_ms"))
    return summary.select("status", "requests", F.round("avg_duration_ms", 3).alias("avg_ms"), F.col("p95_duration_ms").alias("p95_ms"), "p95_is_exact")


# --- order item features and their marts ---------------------------------------------------------------------


def _all_sales(s: Silver) -> DataFrame:
    return gold.fact_sales_items(s.order_items, s.order_heads, s.products, s.sellers, s.customers, s.order_payments)


@query
def order_logistics(spark: SparkSession, folder: str) -> DataFrame:
    return facts.logistics(Silver(spark, folder).orders)


@query
def purchase_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar features of the events, whose timestamps have a time of day."""
    events = Silver(spark, folder).raw("events").select("event_id", "ts")
    return facts.calendar(events, "ts").drop("ts")


@query
def customer_features(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    mart = gold.mart_customer_behavior(s.customers, s.order_heads, s.order_items)
    return facts.customer_features(mart, "2001-09-01 00:00:00")


@query
def seller_features(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    mart = gold.mart_seller_performance(s.sellers, s.order_items, s.orders, s.order_reviews)
    return facts.seller_features(mart, s.order_items, s.order_heads)


@query
def customer_balance_rank(spark: SparkSession, folder: str) -> DataFrame:
    """RANK over all customers by whole hundreds of their balance (many ties)."""
    hundreds = F.floor(F.col("c_acctbal") / 100).cast("int")
    customers = Silver(spark, folder).raw("customer").withColumn("hundreds", hundreds)
    return global_rank(customers, "hundreds", "pos").select("c_custkey", "hundreds", "pos")


@query
def product_features(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return facts.product_features(s.products, s.order_items, s.order_reviews)


@query
def payment_features(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return facts.payment_features(s.order_payments, s.order_items)


@query
def order_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Places lie at (key, -2 x key) degrees; distances in whole metres, as trigonometry differs in the last bits.

    The places of one region are spelled in another way, so that nobody's place is found there.
    """
    s = Silver(spark, folder)
    places = s.places.select(
        F.when(F.col("state") == "ASIA", F.upper(F.concat("city", F.lit(" *")))).otherwise(F.col("city")).alias("city"),
        "state",
        F.col("n_nationkey").cast("double").alias("avg_lat"),
        (F.col("n_nationkey") * -2).cast("double").alias("avg_lng"),
    )
    found = facts.order_distances(_all_sales(s), places)
    return found.withColumn("distance_km", F.round("distance_km", 3))


@query
def urban_places(spark: SparkSession, folder: str) -> DataFrame:
    """Places at (key, -2 x key) degrees in cells of four degrees; urban is a share of two fifths of all customers around."""
    s = Silver(spark, folder)
    places = s.places.select(
        "city",
        "state",
        F.col("n_nationkey").cast("double").alias("avg_lat"),
        (F.col("n_nationkey") * -2).cast("double").alias("avg_lng"),
    )
    return facts.urban_places(places, s.customers, 4.0, 2 * s.raw("customer").count() // 5)


@query
def sales_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return facts.sales_summary(gold.sold_items(s.order_items, s.order_heads))


@query
def category_performance(spark: SparkSession, folder: str) -> DataFrame:
    return facts.category_performance(_sales_with_category(Silver(spark, folder)))


@query
def state_performance(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    homes = s.customers.select("customer_id", "customer_state")
    return facts.state_performance(gold.sold_items(s.order_items, s.order_heads).join(homes, "customer_id", "left"))


@query
def payment_method_performance(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return facts.payment_method_performance(_all_sales(s))


@query
def delivery_performance(spark: SparkSession, folder: str) -> DataFrame:
    s = Silver(spark, folder)
    return facts.delivery_performance(s.orders, s.customers, s.order_reviews)


@query
def zip_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return facts.zip_prefixes(standins.bronze_geolocation(Silver(spark, folder)))


@query
def quality_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of the orders, every tenth of which names an unknown customer."""
    s = Silver(spark, folder)
    known = s.raw("customer").select(F.col("c_custkey").alias("customer_id"))
    orders = s.orders.withColumn("customer_id", _every_tenth_unknown("order_id", "customer_id"))
    return facts.quality_issues(orders, known, s.order_payments)


# --- landing, streaming, build -----------------------------------------------------------------------------


def _land(spark: SparkSession, df: DataFrame, folder: str, table: str) -> str:
    path = f"{folder}/{table}"
    bronze.export_csv(df, path)
    return path


@query
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews with line breaks and quotes in their text, exported as CSV and landed again."""
    s = Silver(spark, folder)
    path = _land(spark, standins.bronze_order_reviews(s), scratch_folder(spark, "landing"), "order_reviews")
    return silver.order_reviews(bronze.read_landing(spark, path, registry.REGISTRY["order_reviews"]))


def _customer_files(spark: SparkSession, folder: str, root: str) -> None:
    """Customers in three files: untidy names; the columns in another order; one column less and one more.

    Two of the files have the same name in folders of the same name.
    """
    raw = Silver(spark, folder).raw("customer")
    key, name = F.col("c_custkey"), F.col("c_name")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "N/A").otherwise(F.col("c_mktsegment"))
    third = raw.filter(key % 3 == 0)
    parts = {
        "day one/customers/p.csv": raw.filter(key % 3 == 1).select(
            key.alias(" Customer ID "), segment.alias("Market Segment"), name.alias("C_Name")
        ),
        "day two/customers/p.csv": raw.filter(key % 3 == 2).select(
            name.alias("C_Name"), key.alias("customer_id"), segment.alias("MARKET_SEGMENT")
        ),
        "day two/customers/q.csv": third.select(key.alias("customer_id"), name.alias("c_name"), F.col("c_nationkey")),
    }
    for path, rows in parts.items():
        bronze.export_csv(rows, f"{root}/{path}")


@query
def landed_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers from files with differing headers, each read by its own, with their provenance."""
    root = scratch_folder(spark, "landing")
    _customer_files(spark, folder, root)
    files = bronze.file_checksums(spark, root, bronze.landing_files(spark, root)).withColumn("run_id", F.lit("run-1"))
    named = [(r["path"], r["header"]) for r in files.filter(F.col("header").isNotNull()).select("path", "header").collect()]
    rows = bronze.read_landings(spark, named, registry.REGISTRY["customers"], root)
    rows = bronze.read_bronze(rows, files)
    return rows.select(
        "customer_id",
        "market_segment",
        "c_name",
        F.col("c_nationkey").alias("nation"),
        F.regexp_replace("_source_file", "/part-.*", "").alias("source_folder"),
        (F.length("_source_checksum") == 32).alias("has_checksum"),
        F.col("_ingested_at").isNotNull().alias("has_time"),
        "_ingestion_run_id",
    )


@query
def file_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and digest of CSV files made of the nations by region, one file each."""
    root = scratch_folder(spark, "landing")
    raw = Silver(spark, folder).raw("supplier").withColumn("r", F.pmod("s_nationkey", F.lit(5)))
    line = F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey")
    raw.repartition(5, "r").select(line.alias("value"), "r").write.partitionBy("r").text(root)
    files = bronze.landing_files(spark, root, "*.txt")
    summed = bronze.file_checksums(spark, root, files)
    return summed.select(F.regexp_extract("file_name", r"^(r=\d+)/", 1).alias("file"), "length", "checksum")


@query
def second_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers landed, ingested, changed and ingested again; then nothing is left to load."""
    root = scratch_folder(spark, "second")
    store, log = TableStore(spark, f"{root}/warehouse"), runlog.OpsLog(spark, f"{root}/warehouse")
    raw = Silver(spark, folder).raw("supplier")
    columns = [F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("seller_zip_code_prefix")]
    first = raw.select(*columns, F.col("s_name").alias("seller_city"), F.lit("S1").alias("seller_state"))
    bronze.export_csv(first.filter("seller_id % 4 != 0"), f"{root}/in/day1/sellers")
    build.ingest(spark, store, log, f"{root}/in")
    later = raw.select(F.lit("S2").alias("seller_state"), F.upper("s_name").alias("seller_city"), *columns)
    bronze.export_csv(later.filter("seller_id % 3 = 0 OR seller_id % 4 = 0"), f"{root}/in/day2/sellers")
    build.ingest(spark, store, log, f"{root}/in")
    left = bronze.plan_ingest(spark, f"{root}/in", log.runs(), store.tables()).agg(F.count("*"))
    done = log.runs().filter("status = 'success'").agg(F.sum("inserted_rows"))
    table = store.read("bronze", "sellers").select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")
    return table.withColumns({"files_left": left.scalar(), "rows_logged": done.scalar()})


@query
def incremental_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Two arrivals of order files streamed into one table; the second changes open orders and adds pending ones."""
    root = scratch_folder(spark, "stream")
    store = TableStore(spark, f"{root}/warehouse")
    text = standins.bronze_orders(Silver(spark, folder))
    status = F.trim("order_status")
    arrivals = [
        text.filter(status != "PROCESSING"),
        text.filter(status != "DELIVERED").withColumn("order_status", F.concat(F.lit("re"), status)),
    ]
    spec = replace(S.ORDERS, kept=("order_estimated_delivery_date",))

    for rows in arrivals:
        rows.write.mode("append").options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(f"{root}/landing")
        incremental.incremental_ingest(
            spark,
            f"{root}/landing",
            bronze.text_schema(text.columns),
            silver.orders,
            store,
            spec,
            [F.col("order_status").asc_nulls_last()],
            f"{root}/ingest",
        )
    return store.read("silver", "orders")


class _Later(Silver):
    """The tables some time later: every supplier has moved to another nation, and many open orders are filled."""

    def raw(self, name: str) -> DataFrame:
        df = super().raw(name)
        if name == "supplier":
            return df.withColumn("s_nationkey", F.pmod(F.col("s_nationkey") + 1, F.lit(25)).cast("int"))
        if name == "orders":
            filled = (F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0)
            return df.withColumn("o_orderstatus", F.when(filled, "F").otherwise(F.col("o_orderstatus")))
        return df


def _land_together(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    build.together([lambda t=t, rows=rows: _land(spark, rows, folder, t) for t, rows in tables.items()])


def _digests(store: TableStore, number: int) -> DataFrame:
    """(build, table_name, row_count, digest) of all models' tables as they are now."""

    def one(m: S.TableSpec) -> DataFrame:
        digest = quality.content_digest(store.read(m.layer, m.name), m.columns)
        return digest.select(F.lit(number).alias("build"), F.lit(f"{m.layer}.{m.name}").alias("table_name"), "row_count", "digest")

    return quality.union_all(one(m) for m in S.MODELS)


@query
def stream_log(spark: SparkSession, folder: str) -> DataFrame:
    """Customers streamed from four files; the run log and the rows' provenance must tell of the same files and rows."""
    root = scratch_folder(spark, "stream-log")
    store, log = TableStore(spark, f"{root}/warehouse"), runlog.OpsLog(spark, f"{root}/warehouse")
    s = Silver(spark, folder)
    text = standins.bronze_customers(s).withColumnRenamed("customer_id", " Customer ID ")
    bronze.export_csv(text.repartition(4), f"{root}/landing")
    names = standins.place_map(s)
    incremental.incremental_ingest(
        spark,
        f"{root}/landing",
        bronze.text_schema(text.columns),
        lambda rows: silver.customers(rows, names),
        store,
        S.CUSTOMERS,
        [F.col("customer_unique_id").asc_nulls_last()],
        f"{root}/ingest",
        files_per_batch=3,
        log=log,
    )
    rows = incremental.streamed_bronze(spark, f"{root}/ingest")
    per_file = rows.groupBy("_source_file", "_source_checksum", "_ingestion_run_id").agg(F.count("*").alias("n"))
    runs = log.runs().filter("status = 'success'").select(
        F.col("run_id").alias("_ingestion_run_id"),
        F.col("source_file").alias("_source_file"),
        F.col("source_checksum").alias("_source_checksum"),
        F.col("inserted_rows").alias("logged"),
    )
    both = runs.join(per_file, ["_ingestion_run_id", "_source_file", "_source_checksum"], "full_outer")
    return both.agg(
        F.count("*").alias("files"),
        F.sum("logged").alias("rows_logged"),
        F.sum("n").alias("rows_staged"),
        F.count_if(~F.col("logged").eqNullSafe(F.col("n"))).alias("files_that_differ"),
        F.countDistinct("_ingestion_run_id").alias("run_ids"),
    )


@query
def gated_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Three snapshots of the places of customers: the second has fewer rows than the first and is dropped, the third more."""
    root = scratch_folder(spark, "gate")
    store, log = TableStore(spark, f"{root}/warehouse"), runlog.OpsLog(spark, f"{root}/warehouse")
    places = standins.bronze_geolocation(Silver(spark, folder)).withColumn("one", F.lit(0))
    total = places.count()
    snapshots = {
        "1 first": places,
        "2 fewer": places.groupBy(*[c for c in places.columns if c != "one"]).agg(F.max("one").alias("one")).withColumn("one", F.lit(1)),
        "3 more": places.unionByName(places.withColumn("one", F.lit(2))),
    }
    steps = []
    for name, rows in snapshots.items():
        _land(spark, rows, f"{root}/{name}", "geolocation")
        build.ingest(spark, store, log, f"{root}/{name}", expected_rows={"geolocation": total})
        table = store.read("reference", "geolocation").agg(F.count("*").alias("table_rows"), F.max("one").alias("newest"))
        steps.append(table.select(F.lit(name).alias("snapshot"), "table_rows", "newest"))
    # A snapshot of one file or more; all of one have one status.
    states = log.runs().groupBy("status").agg(F.sum("total_rows").alias("n"))
    kept = states.filter("status = 'kept'").agg(F.sum("n"))
    return quality.union_all(steps).withColumn("rows_kept_out", kept.scalar())


def _small_warehouse(spark: SparkSession, folder: str) -> TableStore:
    """Customers, sellers and the monthly mart as stored tables."""
    s, store = Silver(spark, folder), TableStore(spark, f"{scratch_folder(spark, 'tables')}/warehouse")
    store.publish(standins.bronze_sellers(s), "bronze", "sellers")
    build.refresh(store, S.CUSTOMERS, silver.customers(standins.bronze_customers(s), standins.place_map(s)))
    build.refresh(store, S.MART_MONTHLY, gold.mart_monthly_from_items(s.order_items, s.order_heads))
    return store


@query
def catalog_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of the stored tables, with its description."""
    return profile.catalog(_small_warehouse(spark, folder).tables())


@query
def layer_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Which layers hold a table: one of those asked for does not."""
    return checks.layer_presence(_small_warehouse(spark, folder).tables(), ("bronze", "silver", "gold", "master"))


@query
def required_column_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Tables against the columns their models declare; the landed sellers lack one and orders two."""
    s = Silver(spark, folder)
    landed = {"sellers": standins.bronze_sellers(s).drop("seller_state"), "products": standins.bronze_products(s)}
    models = {"orders": s.orders.drop("order_status", "order_approved_at"), "mart_monthly_performance": gold.mart_monthly_from_items(s.order_items, s.order_heads)}
    return checks.required_columns(landed, landed=True).unionByName(checks.required_columns(models))


@query
def quality_log(spark: SparkSession, folder: str) -> DataFrame:
    """The results of the warehouse checks as they come back from the log they were recorded in."""
    log = runlog.OpsLog(spark, scratch_folder(spark, "quality"))
    log.record_quality(warehouse_checks(spark, folder))
    log.record_quality(column_tests(spark, folder))
    stored = log.quality().withColumn("has_time", F.col("validation_time").isNotNull())
    return stored.drop("validation_time")


@query
def reused_result(spark: SparkSession, folder: str) -> DataFrame:
    """A statement that is asked twice, the second time with other white space; its result is kept from the first."""
    text = f"SELECT c_mktsegment, count(*) AS customers, max(c_custkey) AS newest FROM parquet.`{folder}/customer.parquet` GROUP BY 1"
    results.forget_results()
    first = results.reused_sql(spark, text)
    again = results.reused_sql(spark, f"  {text}\n")
    return again.withColumn("is_kept", F.lit(again is first))


@query
def warehouse_build(spark: SparkSession, folder: str) -> DataFrame:
    """All tables landed as CSV, ingested, cleaned, modelled and validated; then changed sellers and orders, and a second
    build on top, in which kept columns keep their first values. Rows and contents of every table after each."""
    s, later = Silver(spark, folder), _Later(spark, folder)
    root = scratch_folder(spark, "build")
    store, log = TableStore(spark, f"{root}/warehouse"), runlog.OpsLog(spark, f"{root}/warehouse")
    landing = {
        "customers": standins.bronze_customers(s),
        "sellers": standins.bronze_sellers(s),
        "products": standins.bronze_products(s),
        "orders": standins.bronze_orders(s),
        "order_items": standins.bronze_order_items(s),
        "order_payments": standins.bronze_order_payments(s),
        "order_reviews": standins.bronze_order_reviews(s),
        "geolocation": standins.bronze_geolocation(s),
        "geography_master": standins.place_map(s),
        "product_category_mapping": standins.category_map(s),
    }
    _land_together(spark, landing, f"{root}/landing/first")
    build.ingest_in_order(spark, store, log, f"{root}/landing")
    build.build_warehouse(spark, store, log)
    first = _digests(store, 1)
    changed = {"sellers": standins.bronze_sellers(later), "orders": standins.bronze_orders(later)}
    _land_together(spark, changed, f"{root}/landing/second")
    build.ingest_in_order(spark, store, log, f"{root}/landing")
    build.build_warehouse(spark, store, log)
    return first.unionByName(_digests(store, 2))
