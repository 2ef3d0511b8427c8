"""SQL counterparts of the registered queries, for an independent engine on the same tables.

They are written the plain way (joins that repeat rows, COUNT DISTINCT, ROW_NUMBER), not the way the Spark
plans are, so that they check the rewrites as well.
"""

from __future__ import annotations

from orderloom.schemas import CUSTOMERS as CUSTOMERS_SPEC
from orderloom.schemas import MART_MONTHLY, MODELS, UPDATED_AT, TableSpec
from orderloom.schemas import SELLERS as SELLERS_SPEC

ORACLE: dict[str, str] = {}

# --- the silver tables -------------------------------------------------------------------------------------

PLACES = """places AS (
    SELECT n_nationkey, n_name AS city, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey)"""

CUSTOMERS = """customers AS (
    SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, c_nationkey AS customer_zip_code_prefix,
           city AS customer_city, state AS customer_state
    FROM customer JOIN places ON c_nationkey = n_nationkey)"""

SELLERS = """sellers AS (
    SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix, city AS seller_city, state AS seller_state
    FROM supplier JOIN places ON s_nationkey = n_nationkey)"""

PRODUCTS = """products AS (
    SELECT p_partkey AS product_id, p_type AS product_category_name, p_size AS product_photos_qty,
           CAST(p_size AS DOUBLE) AS product_weight_g, CAST(p_size AS DOUBLE) AS product_length_cm,
           CAST(p_size AS DOUBLE) AS product_height_cm, CAST(p_size AS DOUBLE) AS product_width_cm
    FROM part)"""

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' WHEN 'P' THEN 'processing' END"

ORDERS = f"""ords AS (
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, {STATUS} AS order_status,
           o_orderdate AS order_purchase_timestamp, o_orderdate + INTERVAL 1 DAY AS order_approved_at,
           first_ship AS order_delivered_carrier_date, last_ship AS order_delivered_customer_date,
           o_orderdate + INTERVAL 90 DAY AS order_estimated_delivery_date
    FROM orders LEFT JOIN (
        SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey
    ) ships ON l_orderkey = o_orderkey)"""

LINES = """lines AS (
    SELECT * FROM lineitem QUALIFY 1 = row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_extendedprice DESC NULLS LAST, l_partkey, l_suppkey, l_shipdate, l_quantity, l_tax, l_returnflag))"""

ITEMS = f"""{LINES}, items AS (
    SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
           l_shipdate AS shipping_limit_date, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
           CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS freight_value
    FROM lines)"""

PAYMENTS = """payments AS (
    SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential, l_returnflag AS payment_type,
           CAST(l_quantity AS INTEGER) AS payment_installments, CAST(l_extendedprice AS DECIMAL(18,2)) AS payment_value
    FROM lines)"""

REVIEWS = """reviews AS (
    SELECT o_orderkey AS review_id, o_orderkey AS order_id, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS review_score
    FROM orders)"""

VALUE = "CAST(price AS DECIMAL(18,4)) + freight_value"

PRIMARY_PAYMENTS = """primary_payments AS (
    SELECT order_id, payment_type, payment_installments FROM payments QUALIFY 1 = row_number() OVER (
        PARTITION BY order_id ORDER BY payment_value DESC NULLS FIRST, payment_sequential))"""

PRIMARY_SELLERS = """primary_sellers AS (
    SELECT order_id, seller_id, seller_city, seller_state FROM items JOIN sellers USING (seller_id)
    QUALIFY 1 = row_number() OVER (PARTITION BY order_id ORDER BY price DESC NULLS FIRST, order_item_id))"""


def days(later: str, earlier: str) -> str:
    """Whole days cut toward zero."""
    micros = f"(epoch_us({later}) - epoch_us({earlier}))"
    return f"CAST(trunc({micros} / 86400000000.0) AS INTEGER)"


def money(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


FACT_SALES = f"""sales AS (
    SELECT order_id || '-' || order_item_id AS order_item_key, order_id, order_status, order_purchase_timestamp,
           product_id, product_category_name, product_weight_g, product_length_cm, product_height_cm, product_width_cm,
           seller_id, seller_city, seller_state, customer_id, customer_city, customer_state,
           payment_type, payment_installments, price, freight_value, {VALUE} AS total_value
    FROM items JOIN ords USING (order_id) LEFT JOIN primary_payments USING (order_id)
    LEFT JOIN customers USING (customer_id) LEFT JOIN products USING (product_id) LEFT JOIN sellers USING (seller_id))"""

ALL_FOR_SALES = ", ".join(
    [PLACES, CUSTOMERS, SELLERS, PRODUCTS, ORDERS, ITEMS, PAYMENTS, PRIMARY_PAYMENTS, FACT_SALES]
)

FULFILLMENT = f"""fulfillment AS (
    SELECT order_id, customer_unique_id, customer_city, customer_state, seller_id, seller_city, seller_state,
           order_status, order_purchase_timestamp, order_approved_at, order_delivered_carrier_date,
           order_delivered_customer_date, order_estimated_delivery_date,
           {days("order_delivered_customer_date", "order_purchase_timestamp")} AS delivery_days_actual,
           {days("order_estimated_delivery_date", "order_purchase_timestamp")} AS delivery_days_estimated,
           {days("order_delivered_carrier_date", "order_approved_at")} AS processing_days,
           order_delivered_customer_date > order_estimated_delivery_date AS is_late_delivery, score AS review_score
    FROM ords JOIN customers USING (customer_id) LEFT JOIN primary_sellers USING (order_id)
    LEFT JOIN (SELECT order_id, CAST(round(avg(review_score)) AS INTEGER) AS score FROM reviews GROUP BY order_id) rated
        USING (order_id))"""

ALL_FOR_FULFILLMENT = ", ".join(
    [PLACES, CUSTOMERS, SELLERS, ORDERS, ITEMS, REVIEWS, PRIMARY_SELLERS, FULFILLMENT]
)

MONTHLY = f"""monthly AS (
    SELECT strftime(date_trunc('month', order_purchase_timestamp), '%Y-%m-%d') AS month_start_date,
           {money(f"sum({VALUE})")} AS total_revenue,
           count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS total_customers,
           {money(f"sum({VALUE})")} / count({VALUE}) AS avg_order_value
    FROM sold GROUP BY 1)"""

SOLD = """sold AS (
    SELECT items.*, customer_id, order_status, order_purchase_timestamp, order_delivered_customer_date AS arrived,
           order_estimated_delivery_date AS promised
    FROM items JOIN ords USING (order_id))"""

SOLD_WITH_CATEGORY = f"""{SOLD}, categorised AS (
    SELECT s.*, p.p_type AS product_category_name FROM sold s LEFT JOIN part p ON s.product_id = p.p_partkey)"""

# --- gold models -------------------------------------------------------------------------------------------

ORACLE["fact_sales_items"] = f"""WITH {ALL_FOR_SALES}
SELECT * REPLACE ({money("price")} AS price, {money("freight_value")} AS freight_value, {money("total_value")} AS total_value)
FROM sales"""

ORACLE["fact_order_fulfillment"] = f"WITH {ALL_FOR_FULFILLMENT} SELECT * FROM fulfillment"

CUSTOMER_MART = f"""customer_mart AS (
    SELECT customer_unique_id, max(customer_city) AS customer_city, max(customer_state) AS customer_state,
           min(order_purchase_timestamp) AS first_purchase_at, max(order_purchase_timestamp) AS latest_purchase_at,
           count(DISTINCT order_id) AS total_orders, count(*) AS total_items_bought,
           {money(f"sum({VALUE})")} AS total_lifetime_value,
           {money(f"sum({VALUE})")} / count({VALUE}) AS avg_order_value,
           count(DISTINCT order_id) > 1 AS is_repeat_customer
    FROM items JOIN ords USING (order_id) JOIN customers USING (customer_id) GROUP BY customer_unique_id)"""

ALL_FOR_CUSTOMERS = ", ".join([PLACES, CUSTOMERS, ORDERS, ITEMS, CUSTOMER_MART])

ORACLE["mart_customer_behavior"] = f"WITH {ALL_FOR_CUSTOMERS} SELECT * FROM customer_mart"

ORACLE["mart_monthly_performance"] = f"WITH {ORDERS}, {ITEMS}, {SOLD}, {MONTHLY} SELECT * FROM monthly"

ORACLE["mart_monthly_from_sales"] = ORACLE["mart_monthly_performance"]

_DELIVERED = "FILTER (WHERE order_status = 'delivered')"
_RATED = """rated AS (
    SELECT {key}, CAST(sum(review_score) AS DOUBLE) / count(review_score) AS rating
    FROM items JOIN reviews USING (order_id) GROUP BY {key})"""

ORACLE["mart_seller_performance"] = f"""WITH {PLACES}, {SELLERS}, {ORDERS}, {ITEMS}, {REVIEWS}, {SOLD},
{_RATED.format(key="seller_id")}, per_seller AS (
    SELECT seller_id, {money(f"sum(price) {_DELIVERED}")} AS revenue, count(DISTINCT order_id) {_DELIVERED} AS n_orders,
           count(*) {_DELIVERED} AS n_items, count(price) {_DELIVERED} AS n_prices,
           min(order_purchase_timestamp) {_DELIVERED} AS since,
           count(arrived > promised) {_DELIVERED} AS n_timed,
           count_if(arrived > promised AND order_status = 'delivered') AS n_late
    FROM sold GROUP BY seller_id)
SELECT seller_id, seller_city, seller_state, ifnull(revenue, 0) AS total_revenue, ifnull(n_orders, 0) AS total_orders,
       ifnull(n_items, 0) AS total_items_sold, ifnull(revenue / nullif(n_prices, 0), 0) AS avg_item_price,
       ifnull(rating, 0) AS avg_review_score,
       ifnull(CAST(n_late AS DOUBLE) / nullif(n_timed, 0), 0) AS late_delivery_rate, since AS active_since
FROM sellers LEFT JOIN per_seller USING (seller_id) LEFT JOIN rated USING (seller_id)"""

ORACLE["mart_product_performance"] = f"""WITH {PRODUCTS}, {ORDERS}, {ITEMS}, {REVIEWS}, {SOLD},
{_RATED.format(key="product_id")}, per_product AS (
    SELECT product_id, {money(f"sum(price) {_DELIVERED}")} AS revenue, count(*) {_DELIVERED} AS n_items,
           count(price) {_DELIVERED} AS n_prices
    FROM sold GROUP BY product_id)
SELECT product_id, product_category_name, ifnull(revenue, 0) AS total_revenue, ifnull(n_items, 0) AS total_units_sold,
       ifnull(revenue / nullif(n_prices, 0), 0) AS avg_price, ifnull(rating, 0) AS avg_review_score,
       product_photos_qty AS total_photos, product_weight_g
FROM products LEFT JOIN per_product USING (product_id) LEFT JOIN rated USING (product_id)"""

# --- silver and master models --------------------------------------------------------------------------------

PLACE_MAP = """place_map AS (
    SELECT lower(city) AS raw_city, upper(city[1]) || lower(replace(city, '_', ' ')[2:]) AS canonical_city,
           upper(state) AS state
    FROM places WHERE state <> 'ASIA')"""

ORACLE["master_geography"] = f"""WITH {PLACES}, raw AS (
    SELECT concat('Sao Nation_', split_part(city, '_', 2)) AS city, upper(state) AS state,
           CAST(c_acctbal AS DECIMAL(12,2)) AS balance
    FROM customer JOIN places ON c_nationkey = n_nationkey)
SELECT city, state, CAST(sum(CAST(balance * 0.01 AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_lat,
       CAST(-sum(CAST(balance * 0.01 AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_lng
FROM raw GROUP BY city, state"""

ORACLE["silver_customers"] = f"""WITH {PLACES}, {PLACE_MAP}
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CAST(c_custkey AS VARCHAR) AS customer_unique_id,
       c_nationkey AS customer_zip_code_prefix, coalesce(m.canonical_city, lower(p.city)) AS customer_city,
       coalesce(m.state, upper(p.state)) AS customer_state
FROM customer JOIN places p ON c_nationkey = n_nationkey
LEFT JOIN place_map m ON m.raw_city = lower(p.city) AND m.state = upper(p.state)"""

ORACLE["silver_sellers"] = f"""WITH {PLACES}, {PLACE_MAP}
SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, s_nationkey AS seller_zip_code_prefix,
       coalesce(m.canonical_city, lower(p.city)) AS seller_city, coalesce(m.state, upper(p.state)) AS seller_state
FROM supplier JOIN places p ON s_nationkey = n_nationkey
LEFT JOIN place_map m ON m.raw_city = lower(p.city) AND m.state = upper(p.state)"""

ORACLE["silver_products"] = """
SELECT CAST(p_partkey AS VARCHAR) AS product_id,
       CASE WHEN p_type = 'PROMO' THEN p_type ELSE lower(p_type) || '_goods' END AS product_category_name,
       CAST(length(p_name) AS INTEGER) AS product_name_length,
       CAST(length(p_brand) + 1 AS INTEGER) AS product_description_length, p_size AS product_photos_qty,
       CAST(p_size AS DOUBLE) AS product_weight_g, CAST(p_size AS DOUBLE) AS product_length_cm,
       CAST(p_size AS DOUBLE) AS product_height_cm, CAST(p_size AS DOUBLE) AS product_width_cm
FROM part"""

ORACLE["silver_orders"] = f"""WITH {ORDERS}
SELECT * REPLACE (CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id) FROM ords"""

ORACLE["silver_order_items"] = f"""WITH {ITEMS}
SELECT CAST(order_id AS VARCHAR) AS order_id, order_item_id, CAST(product_id AS VARCHAR) AS product_id,
       CAST(seller_id AS VARCHAR) AS seller_id, shipping_limit_date, {money("price")} AS price,
       {money("freight_value")} AS freight_value
FROM items"""

ORACLE["silver_order_payments"] = f"""WITH {LINES}, {PAYMENTS}
SELECT CAST(order_id AS VARCHAR) AS order_id, payment_sequential, lower(payment_type) AS payment_type,
       payment_installments, {money("payment_value")} AS payment_value
FROM payments"""

ORACLE["silver_order_reviews"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS review_id, CAST(o_orderkey AS VARCHAR) AS order_id,
       CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS review_score,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS review_comment_title,
       concat('said "', o_orderpriority, '",', chr(10), 'status ', o_orderstatus) AS review_comment_message,
       o_orderdate AS review_creation_date, CAST(NULL AS TIMESTAMP) AS review_answer_timestamp
FROM orders"""

ORACLE["csv_round_trip"] = ORACLE["silver_order_reviews"]

ORACLE["rejected_rows"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
       concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'payment_installments' END,
                 CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 2 = 0 OR o_orderkey % 7 = 0 THEN 'price' END) AS bad_columns
FROM orders WHERE o_orderstatus = 'P' OR o_orderstatus <> 'F' AND o_orderkey % 2 = 0 OR o_orderkey % 7 = 0"""

# --- merge and dedupe ----------------------------------------------------------------------------------------

TWO_LOADS = """first_load AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'),
second_load AS (
    SELECT o_orderkey, o_custkey + 1 AS o_custkey, 'new ' || o_orderstatus AS o_orderstatus,
           o_totalprice * 2 AS o_totalprice, 'new ' || o_orderpriority AS o_orderpriority
    FROM orders WHERE o_orderstatus <> 'F')"""

ORACLE["merge_upsert"] = f"""WITH {TWO_LOADS}
SELECT coalesce(f.o_orderkey, s.o_orderkey) AS order_id,
       CASE WHEN f.o_orderkey IS NOT NULL THEN f.o_custkey ELSE s.o_custkey END AS customer_id,
       CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE f.o_orderstatus END AS order_status,
       CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE f.o_totalprice END AS total_price,
       CASE WHEN f.o_orderkey IS NOT NULL THEN f.o_orderpriority ELSE s.o_orderpriority END AS priority
FROM first_load f FULL OUTER JOIN second_load s ON f.o_orderkey = s.o_orderkey"""

ORACLE["merge_upsert_all_columns"] = f"""WITH {TWO_LOADS}
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status, o_totalprice AS total_price,
       o_orderpriority AS priority FROM second_load
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM first_load
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM second_load)"""

ORACLE["refresh_monthly_mart"] = f"""WITH {ORDERS}, {ITEMS}, {SOLD}, {MONTHLY},
first_average AS (
    SELECT strftime(date_trunc('month', order_purchase_timestamp), '%Y-%m-%d') AS month_start_date,
           {money(f"sum({VALUE})")} / count({VALUE}) AS avg_order_value
    FROM sold WHERE order_status = 'delivered' GROUP BY 1)
SELECT m.month_start_date, m.total_revenue, m.total_orders, m.total_customers,
       coalesce(f.avg_order_value, m.avg_order_value) AS avg_order_value
FROM monthly m LEFT JOIN first_average f ON m.month_start_date = f.month_start_date"""

ORACLE["dedupe_first"] = f"WITH {LINES} SELECT * FROM lines"

ORACLE["primary_payments"] = f"WITH {LINES}, {PAYMENTS}, {PRIMARY_PAYMENTS} SELECT * FROM primary_payments"

ORACLE["primary_sellers"] = f"WITH {PLACES}, {SELLERS}, {ITEMS}, {PRIMARY_SELLERS} SELECT * FROM primary_sellers"

ORACLE["lookup_names"] = f"""WITH {PLACES}
SELECT c_custkey, coalesce(
    (SELECT city FROM places WHERE n_nationkey = c_nationkey AND state <> 'ASIA'), '#' || c_nationkey) AS nation_name
FROM customer"""

ORACLE["customer_match_count"] = """
SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 10 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)) AS matched_rows
FROM orders"""

# --- business questions --------------------------------------------------------------------------------------

ORACLE["total_revenue"] = f"""WITH {ORDERS}, {ITEMS}, {SOLD}
SELECT {money(f"sum({VALUE})")} AS total_revenue FROM sold"""

_VOLUME = f"""WITH {ORDERS}, {ITEMS}, {SOLD_WITH_CATEGORY}
SELECT product_category_name, count(*) AS sales_volume FROM categorised
GROUP BY 1 ORDER BY sales_volume DESC, product_category_name LIMIT """
ORACLE["top_category"] = _VOLUME + "1"
ORACLE["top_categories_by_sales"] = _VOLUME + "5"

ORACLE["category_revenue"] = f"""WITH {ORDERS}, {ITEMS}, {SOLD_WITH_CATEGORY}
SELECT product_category_name, {money(f"sum({VALUE})")} AS revenue FROM categorised
GROUP BY 1 ORDER BY revenue DESC, product_category_name LIMIT 10"""

ORACLE["top_states"] = f"""WITH {ALL_FOR_CUSTOMERS}
SELECT customer_state, count(DISTINCT customer_unique_id) AS customer_count FROM customer_mart
GROUP BY 1 ORDER BY customer_count DESC, customer_state LIMIT 7"""

ORACLE["monthly_growth"] = f"""WITH {ORDERS}, {ITEMS}, {SOLD}, {MONTHLY},
trend AS (
    SELECT month_start_date, total_revenue, lag(total_revenue) OVER (ORDER BY month_start_date) AS previous_revenue,
           lag(revenue) OVER (ORDER BY month_start_date) AS previous, revenue
    FROM monthly JOIN (
        SELECT strftime(date_trunc('month', order_purchase_timestamp), '%Y-%m-%d') AS month_start_date,
               sum({VALUE}) AS revenue FROM sold GROUP BY 1) exact USING (month_start_date))
SELECT month_start_date, total_revenue, previous_revenue,
       CASE WHEN previous_revenue <> 0 THEN {money("revenue - previous")} / previous_revenue END AS growth_rate
FROM trend"""

ORACLE["delivery_delays"] = f"""WITH {ALL_FOR_FULFILLMENT}
SELECT customer_state, strftime(date_trunc('month', order_purchase_timestamp), '%Y-%m-%d') AS purchase_month,
       count(*) AS orders, count(delivery_days_actual) AS deliveries,
       count(*) FILTER (WHERE is_late_delivery) AS late_deliveries,
       CAST(count(*) FILTER (WHERE is_late_delivery) AS DOUBLE) / nullif(count(delivery_days_actual), 0) AS late_rate,
       CAST(sum(delivery_days_actual) AS DOUBLE) / nullif(count(delivery_days_actual), 0) AS avg_delivery_days,
       CAST(sum(delivery_days_actual - delivery_days_estimated) AS DOUBLE)
           / nullif(count(delivery_days_actual - delivery_days_estimated), 0) AS avg_days_over_estimate
FROM fulfillment GROUP BY 1, 2"""

ORACLE["review_by_state"] = f"""WITH {ALL_FOR_FULFILLMENT}
SELECT customer_state, CAST(sum(review_score) AS DOUBLE) / count(review_score) AS avg_review_score,
       count(review_score) AS reviewed_orders
FROM fulfillment GROUP BY 1"""

# --- quality -------------------------------------------------------------------------------------------------

ORACLE["warehouse_checks"] = f"""WITH {ORDERS}, {ITEMS}, {PAYMENTS}, {SOLD}, checks AS (
    SELECT 'orders_no_null_ids' AS validation_name, 'silver' AS layer_name,
           (SELECT count(*) FROM ords WHERE order_id IS NULL) AS issue_count
    UNION ALL SELECT 'orders_unique_ids', 'silver',
           (SELECT count(*) FROM (SELECT order_id FROM ords GROUP BY 1 HAVING count(*) > 1) d)
    UNION ALL SELECT 'payment_values_positive', 'silver', (SELECT count(*) FROM payments WHERE payment_value < 0)
    UNION ALL SELECT 'sales_integrity_silver_gold', 'gold',
           CASE WHEN abs((SELECT sum({VALUE}) FROM items) - (SELECT sum({VALUE}) FROM sold)) < 0.01 THEN 0 ELSE 1 END)
SELECT validation_name, layer_name, issue_count = 0 AS passed, CAST(issue_count AS BIGINT) AS issue_count FROM checks"""

_COLUMN_TESTS = f"""WITH known AS (SELECT c_custkey AS customer_id FROM customer),
keys AS (SELECT concat(l_orderkey, '-', l_linenumber) AS order_item_key FROM lineitem),
checks AS (
    SELECT 'unique_customer_id' AS validation_name, 'silver' AS layer_name,
           (SELECT count(*) FROM (SELECT customer_id FROM known GROUP BY 1 HAVING count(*) > 1) d) AS issue_count
    UNION ALL SELECT 'not_null_customer_id', 'silver', (SELECT count(*) FROM known WHERE customer_id IS NULL)
    UNION ALL SELECT 'unique_order_id', 'silver',
           (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) d)
    UNION ALL SELECT 'not_null_order_id', 'silver', (SELECT count(*) FROM orders WHERE o_orderkey IS NULL)
    UNION ALL SELECT 'relationship_customer_id', 'silver',
           (SELECT count(*) FROM orders WHERE o_custkey IS NOT NULL AND (o_orderkey % 10 = 0 OR o_custkey NOT IN (SELECT customer_id FROM known)))
    UNION ALL SELECT 'unique_order_item_key', 'gold',
           (SELECT count(*) FROM (SELECT order_item_key FROM keys GROUP BY 1 HAVING count(*) > 1) d)
    UNION ALL SELECT 'not_null_order_item_key', 'gold', (SELECT count(*) FROM keys WHERE order_item_key IS NULL))
"""
ORACLE["column_tests"] = f"""{_COLUMN_TESTS}
SELECT validation_name, layer_name, issue_count = 0 AS passed, issue_count FROM checks"""
ORACLE["issue_total"] = f"{_COLUMN_TESTS} SELECT CAST(sum(issue_count) AS BIGINT) AS issue_count FROM checks"

ORACLE["row_checks"] = """WITH checks AS (
    SELECT 'discount_above_five_percent' AS validation_name, count(*) FILTER (WHERE l_discount > 0.05::DOUBLE) AS issue_count FROM lineitem
    UNION ALL SELECT 'price_missing', count(*) FILTER (WHERE l_extendedprice IS NULL) FROM lineitem
    UNION ALL SELECT 'quantity_not_positive', count(*) FILTER (WHERE l_quantity <= 0) FROM lineitem
    UNION ALL SELECT 'untaxed', count(*) FILTER (WHERE l_tax = 0) FROM lineitem)
SELECT validation_name, 'bronze' AS layer_name, issue_count = 0 AS passed, issue_count FROM checks"""

ORACLE["row_count_checks"] = """WITH expected(table_name, expected, actual) AS (
    SELECT 'customers', 99441, count(*) FROM customer UNION ALL SELECT 'orders', 99441, count(*) FROM orders
    UNION ALL SELECT 'order_items', 112650, count(*) FROM lineitem UNION ALL SELECT 'products', 32951, count(*) FROM part
    UNION ALL SELECT 'sellers', 3095, count(*) FROM supplier UNION ALL SELECT 'events', NULL, count(*) FROM events
    UNION ALL SELECT 'geography_master', 6333, NULL UNION ALL SELECT 'product_category_mapping', 73, NULL
    UNION ALL SELECT 'geolocation', 1000163, NULL UNION ALL SELECT 'order_payments', 103886, NULL
    UNION ALL SELECT 'order_reviews', 99224, NULL UNION ALL SELECT 'product_category_name_translation', 71, NULL)
SELECT table_name, 'row_count' AS "check", CAST(expected AS BIGINT) AS expected, actual, actual = expected AS passed,
       CASE WHEN expected IS NULL THEN 'skipped' WHEN actual IS NULL THEN 'missing' ELSE 'compared' END AS status
FROM expected"""

ORACLE["yearly_counts"] = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS actual FROM orders GROUP BY 1"""

ORACLE["yearly_count_checks"] = f"""WITH {ORDERS}
SELECT 'orders' AS table_name, concat('year_', s.y, '_count') AS "check", s.n AS expected, coalesce(o.n, 0) AS actual,
       coalesce(o.n, 0) = s.n AS passed, 'compared' AS status
FROM (SELECT year(order_delivered_customer_date) AS y, count(*) AS n FROM ords
      WHERE order_delivered_customer_date IS NOT NULL GROUP BY 1) s
LEFT JOIN (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) o ON s.y = o.y"""

ORACLE["growth_gate"] = """WITH new AS (
    SELECT CAST(year(l_shipdate) AS VARCHAR) AS table_name, count(*) AS n FROM lineitem GROUP BY 1),
expected AS (
    SELECT CAST(year(o_orderdate) AS VARCHAR) AS table_name, count(*) AS n
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT new.table_name, new.n AS new_rows, expected.n AS expected_rows,
       CASE WHEN expected.table_name IS NULL OR new.table_name >= '2000' OR new.n > expected.n THEN 'accept'
            WHEN new.n < expected.n THEN 'warn_keep' ELSE 'keep' END AS decision
FROM new LEFT JOIN expected USING (table_name)"""

ORACLE["renew_expectations"] = f"""WITH {ORDERS}
SELECT order_status AS table_name,
       CASE WHEN order_status = 'shipped' THEN count(*) ELSE count(order_delivered_customer_date) END AS row_count,
       CASE WHEN order_status = 'shipped' THEN '1.1.9' ELSE '1.1.10' END AS version
FROM ords GROUP BY order_status"""

# --- profiling -----------------------------------------------------------------------------------------------

ORACLE["value_counts"] = "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type"

ORACLE["distinct_counts"] = """
SELECT 'l_orderkey' AS column_name, count(DISTINCT l_orderkey) AS n_distinct FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem
UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem"""

def _profile(table: str, kinds: dict[str, str]) -> str:
    shown = {"timestamp_ntz": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "double": "CAST({0} AS DECIMAL(18,2))"}
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, count(*) AS row_count,
    count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(DISTINCT {c}) AS n_distinct, true AS estimate_is_close,
    CAST({shown.get(kind, "{0}").format(f"min({c})")} AS VARCHAR) AS min_value,
    CAST({shown.get(kind, "{0}").format(f"max({c})")} AS VARCHAR) AS max_value FROM {table}"""
        for c, kind in kinds.items()
    )


ORACLE["column_profile"] = _profile(
    "orders",
    {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz",
        "o_orderpriority": "string",
    },
)
ORACLE["column_profile_documents"] = _profile(
    "documents", {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
)
ORACLE["approx_distinct_counts"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, true AS estimate_is_close FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
)
ORACLE["example_values"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, (SELECT string_agg(v, '|' ORDER BY v) FROM (
    SELECT DISTINCT {c} AS v FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 20) WHERE length({c}) < 50 ORDER BY 1 LIMIT 5)) AS examples"""
    for c in ("p_name", "p_brand", "p_type")
)

_SEQUENCES = """SELECT {key} AS k, count(*) = max({seq}) AND count(DISTINCT {seq}) = max({seq}) AND min({seq}) = 1
    AND count(*) = count({seq}) AS is_contiguous FROM {table} GROUP BY 1"""

ORACLE["sequence_verdicts"] = f"""
SELECT is_contiguous, count(*) AS orders
FROM ({_SEQUENCES.format(key="l_orderkey", seq="l_linenumber", table="lineitem")}) v GROUP BY 1"""

ORACLE["sequence_gaps"] = f"""WITH {LINES}, {PAYMENTS}
SELECT order_id, payment_sequential, payment_type, payment_installments, {money("payment_value")} AS payment_value
FROM payments WHERE order_id IN (
    SELECT k FROM ({_SEQUENCES.format(key="order_id", seq="payment_sequential", table="payments")}) v WHERE NOT is_contiguous)"""

ORACLE["repeated_payment_type"] = f"""WITH {LINES}, {PAYMENTS}
SELECT order_id, payment_sequential, payment_type, payment_installments, {money("payment_value")} AS payment_value
FROM payments WHERE order_id IN (
    SELECT order_id FROM payments GROUP BY 1 HAVING count(*) FILTER (WHERE payment_type = 'A') > 1)"""

ORACLE["order_violations"] = f"""WITH {ORDERS}
SELECT 'approved_before_purchase' AS rule, count(*) FILTER (WHERE order_approved_at < order_purchase_timestamp) AS violations FROM ords
UNION ALL SELECT 'carrier_before_approved', count(*) FILTER (WHERE order_delivered_carrier_date < order_approved_at) FROM ords
UNION ALL SELECT 'delivered_before_carrier', count(*) FILTER (WHERE order_delivered_customer_date < order_delivered_carrier_date) FROM ords
UNION ALL SELECT 'estimated_before_purchase', count(*) FILTER (WHERE order_estimated_delivery_date < order_purchase_timestamp) FROM ords
UNION ALL SELECT 'delivered_after_estimated', count(*) FILTER (WHERE order_delivered_customer_date > order_estimated_delivery_date) FROM ords"""


def _describe(source: str, decimals: int) -> str:
    stats = {
        "count": "CAST(count(x) AS DOUBLE)",
        "mean": "avg(x)",
        "std": "stddev_samp(x)",
        "min": "min(x)",
        "25%": "quantile_cont(x, 0.25)",
        "50%": "quantile_cont(x, 0.5)",
        "75%": "quantile_cont(x, 0.75)",
        "max": "max(x)",
    }
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS stat, round({f}, {decimals}) AS value FROM {source}" for name, f in stats.items()
    )


ORACLE["interval_summary"] = f"""WITH {ORDERS}, gaps AS (
    SELECT (epoch_us(order_approved_at) - epoch_us(order_delivered_carrier_date)) / 1000000.0 AS x FROM ords
    WHERE order_delivered_carrier_date < order_approved_at)
{_describe("gaps", 2)}"""

ORACLE["event_value_summary"] = f"""WITH vals AS (SELECT value AS x FROM events)
{_describe("vals", 6)}"""

ORACLE["surplus_rows"] = """
SELECT CAST(count(*) - (SELECT count(*) FROM (
    SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem) d) AS BIGINT) AS surplus_rows
FROM lineitem"""

ORACLE["surplus_documents"] = """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents) d) AS BIGINT) AS surplus_rows
FROM documents"""

ORACLE["duplicated_rows"] = """
SELECT * FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
    SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"""

ORACLE["parse_report"] = """
SELECT 'order_purchase_timestamp' AS column_name, 0::BIGINT AS before_na, 0::BIGINT AS after_na, 0::BIGINT AS new_invalid
UNION ALL SELECT 'order_approved_at', count(*) FILTER (WHERE o_orderstatus = 'P'),
       count(*) FILTER (WHERE o_orderstatus IN ('P', 'O')), count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders
UNION ALL SELECT 'order_estimated_delivery_date', 0, count(*) FILTER (WHERE o_orderstatus = 'P'),
       count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders"""

ORACLE["fuzzy_top_k"] = """
SELECT name, 1.0::DOUBLE - CAST(levenshtein(name, 'hot gear') AS DOUBLE) / greatest(length(name), 8) AS similarity
FROM (SELECT DISTINCT p_name AS name FROM part) names
ORDER BY similarity DESC, name LIMIT 20"""

# --- functions -----------------------------------------------------------------------------------------------

ORACLE["event_gap_days"] = f"""WITH gaps AS (
    SELECT event_id, ts, min(ts) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS bought_at FROM events)
SELECT event_id, {days("ts", "bought_at")} AS days_since, {days("bought_at", "ts")} AS days_until,
       epoch_us(ts) - epoch_us(bought_at) AS us_since
FROM gaps"""

ORACLE["surrogate_keys"] = """
SELECT o_orderkey, md5(concat(o_orderkey, '|', coalesce(nullif(o_orderstatus, 'P'), ''), '|', o_orderpriority)) AS order_sk,
       CAST(o_orderkey AS VARCHAR) || '-' || nullif(o_orderstatus, 'P') AS order_text_key
FROM orders"""

ORACLE["text_functions"] = """WITH padded AS (
    SELECT doc_id, lang, concat('  ', text, ' ') AS t FROM documents)
SELECT doc_id, md5(nullif(trim(t, ' '), '')) AS blank_to_null_md5, md5(lower(trim(t, ' '))) AS normalized_md5,
       CASE WHEN lang <> 'es' THEN lang END AS lang_or_null,
       upper(lang) AS lang_code
FROM padded"""

ORACLE["numeric_casts"] = """
SELECT CAST(l_quantity AS INTEGER) AS quantity,
       CAST(CASE WHEN l_linenumber < 4 THEN l_linenumber - 5 ELSE l_linenumber - 3 END AS INTEGER) AS rounded_half,
       count(*) AS n, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax
FROM lineitem GROUP BY 1, 2"""

ORACLE["safe_arithmetic"] = """WITH v AS (
    SELECT l_returnflag, l_linestatus, l_tax, l_quantity, CASE WHEN l_linenumber <> 7 THEN l_discount END AS d FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE d <> 0) AS growth_known,
       max((l_tax - d) / nullif(d, 0)) AS growth_max, count(l_quantity / nullif(d, 0)) AS ratio_known,
       max(l_quantity / nullif(d, 0)) AS ratio_max,
       count(*) FILTER (WHERE abs(CAST(l_tax AS DECIMAL(4,2)) - CAST(d AS DECIMAL(4,2))) < 0.01) AS near
FROM v GROUP BY 1, 2"""

ORACLE["place_names"] = r"""WITH cleaned AS (
    SELECT doc_id, trim(translate(lower(split_part(split_part(text, '-', 1), '(', 1)), 'áàâãéêíóôõúç', 'aaaaeeiooouc'), ' ') AS t
    FROM documents)
SELECT doc_id, md5(array_to_string(
    list_transform(regexp_extract_all(t, '[\p{L}\p{N}]+|[^\p{L}\p{N}]'), lambda w: CASE WHEN w[1] = 'ß' THEN w[1] ELSE upper(w[1]) END || w[2:]), '')) AS place_md5
FROM cleaned"""

ORACLE["token_estimates"] = "SELECT conv_id, turn, length(text) // 4 AS tokens FROM conversations"

ORACLE["sanitized_values"] = """
SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup', 'view') THEN value END AS value FROM events"""

# --- result shaping and ad-hoc SQL -----------------------------------------------------------------------------

ORACLE["pivot_sum"] = """
SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS A,
       coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS R,
       coalesce(sum(l_quantity) FILTER (WHERE l_returnflag NOT IN ('A', 'R')), 0) AS other
FROM lineitem GROUP BY 1"""

ORACLE["multi_series"] = """WITH t AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)
SELECT o_orderpriority, o_orderstatus, CAST(sum(p) AS DOUBLE) AS total FROM t GROUP BY 1, 2"""

ORACLE["bounded_sql"] = f"""WITH {ALL_FOR_SALES}
SELECT customer_state, product_category_name, payment_type, count(*) AS items, {money("sum(total_value)")} AS revenue
FROM sales WHERE order_status = 'delivered' GROUP BY 1, 2, 3
ORDER BY revenue DESC, customer_state, product_category_name, payment_type LIMIT 150"""

ORACLE["sample_rows"] = "SELECT * FROM customer ORDER BY c_custkey LIMIT 5"

ORACLE["request_log"] = """
SELECT role AS status, count(*) AS requests, CAST(sum(length(text) // 4) AS BIGINT) AS total_tokens,
       CAST(sum(length(text) // 4) AS DOUBLE) / count(*) AS avg_tokens, max(length(text) // 4) AS max_tokens
FROM conversations GROUP BY 1"""

ORACLE["latest_runs"] = """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value,
       min(ts) AS started_at,
       CASE WHEN arg_max(event_type, (ts, event_id)) IN ('purchase', 'error') THEN max(ts) END AS finished_at
FROM events GROUP BY user_id"""

# --- order item features and their marts -----------------------------------------------------------------------

ORACLE["order_logistics"] = f"""WITH {ORDERS}, d AS (
    SELECT order_id, {days("order_delivered_customer_date", "order_purchase_timestamp")} AS delivery_days,
           {days("order_delivered_customer_date", "order_estimated_delivery_date")} AS delivery_delay_days,
           {days("order_delivered_carrier_date", "order_approved_at")} AS processing_days,
           {days("order_delivered_customer_date", "order_delivered_carrier_date")} AS handling_days,
           {days("order_estimated_delivery_date", "order_purchase_timestamp")} AS promised,
           order_delivered_customer_date > order_estimated_delivery_date AS is_late_delivery
    FROM ords)
SELECT order_id, delivery_days, delivery_delay_days, processing_days, handling_days,
       CAST(delivery_days AS DOUBLE) / nullif(promised, 0) AS delivery_efficiency, is_late_delivery
FROM d"""

ORACLE["purchase_calendar"] = """
SELECT event_id, CAST(year(ts) AS INTEGER) AS purchase_year, CAST(month(ts) AS INTEGER) AS purchase_month,
       CAST(day(ts) AS INTEGER) AS purchase_day, CAST(isodow(ts) AS INTEGER) AS purchase_weekday,
       CAST(hour(ts) AS INTEGER) AS purchase_hour, isodow(ts) >= 6 AS is_weekend,
       strftime(ts, '%m-%d') IN ('01-01', '04-21', '05-01', '09-07', '10-12', '11-02', '11-15', '12-25') AS is_holiday,
       CASE WHEN month(ts) IN (12, 1, 2) THEN 'summer' WHEN month(ts) <= 5 THEN 'autumn'
            WHEN month(ts) <= 8 THEN 'winter' ELSE 'spring' END AS purchase_season
FROM events"""

ORACLE["customer_features"] = f"""WITH {ALL_FOR_CUSTOMERS}, f AS (
    SELECT customer_unique_id, total_orders, total_lifetime_value AS total_spent,
           {days("latest_purchase_at", "first_purchase_at")} AS lifetime_days,
           {days("TIMESTAMP '2001-09-01 00:00:00'", "latest_purchase_at")} AS recency_days
    FROM customer_mart)
SELECT *, CAST(total_orders * 30 AS DOUBLE) / nullif(lifetime_days, 0) AS orders_per_30_days,
       CASE WHEN recency_days <= 30 THEN 5 WHEN recency_days <= 90 THEN 4 WHEN recency_days <= 180 THEN 3
            WHEN recency_days <= 365 THEN 2 ELSE 1 END AS recency_score,
       CASE WHEN total_orders >= 10 THEN 5 WHEN total_orders >= 5 THEN 4 WHEN total_orders >= 3 THEN 3
            WHEN total_orders >= 2 THEN 2 ELSE 1 END AS frequency_score,
       CASE WHEN total_spent >= 1000 THEN 5 WHEN total_spent >= 500 THEN 4 WHEN total_spent >= 200 THEN 3
            WHEN total_spent >= 100 THEN 2 ELSE 1 END AS monetary_score
FROM f"""

ORACLE["seller_features"] = f"""WITH mart AS ({ORACLE["mart_seller_performance"]}), {ORDERS}, {ITEMS}, buyers AS (
    SELECT seller_id, count(DISTINCT customer_id) AS n FROM items i JOIN ords o ON i.order_id = o.order_id GROUP BY 1)
SELECT m.seller_id, m.total_revenue, rank() OVER (ORDER BY m.total_revenue DESC) AS revenue_rank,
       coalesce(b.n, 0) AS unique_customers, m.late_delivery_rate, m.avg_review_score
FROM mart m LEFT JOIN buyers b ON m.seller_id = b.seller_id"""

ORACLE["customer_balance_rank"] = """WITH h AS (SELECT c_custkey, CAST(floor(c_acctbal / 100) AS INTEGER) AS hundreds FROM customer)
SELECT c_custkey, hundreds, rank() OVER (ORDER BY hundreds DESC) AS pos FROM h"""

ORACLE["product_features"] = f"""WITH {ITEMS}, {REVIEWS}, freight AS (
    SELECT product_id, {money("sum(freight_value)")} AS f, count(freight_value) AS n, {money("sum(price)")} AS p
    FROM items GROUP BY 1),
low AS (
    SELECT i.product_id, CAST(count(*) FILTER (WHERE review_score <= 2) AS DOUBLE) / count(review_score) AS risk
    FROM items i JOIN reviews r ON i.order_id = r.order_id GROUP BY 1)
SELECT p_partkey AS product_id, CAST(p_size AS DOUBLE) * p_size * p_size AS volume_cm3,
       CAST(p_size AS DOUBLE) / nullif(CAST(p_size AS DOUBLE) * p_size * p_size, 0) AS density_g_cm3,
       f / n AS avg_shipping_cost, f / p AS freight_ratio, risk AS return_risk
FROM part LEFT JOIN freight ON p_partkey = freight.product_id LEFT JOIN low ON p_partkey = low.product_id"""

ORACLE["payment_features"] = f"""WITH {ITEMS}, {PAYMENTS}, total AS (
    SELECT order_id, {money(f"sum({VALUE})")} AS v FROM items GROUP BY 1),
paid AS (
    SELECT order_id, count(*) AS payments, count(DISTINCT payment_type) AS payment_types,
           max(payment_installments) AS max_installments, count(*) > 1 AS is_multi_payment,
           {money("sum(payment_value)")} AS v
    FROM payments GROUP BY 1)
SELECT p.order_id, payments, payment_types, max_installments, is_multi_payment, p.v / t.v AS payment_to_order_ratio
FROM paid p LEFT JOIN total t ON p.order_id = t.order_id"""

ORACLE["order_distances"] = f"""WITH {ALL_FOR_SALES}, ends AS (
    SELECT order_item_key, customer_state = seller_state AS is_same_state,
           radians(c.n_nationkey) AS lat1, radians(c.n_nationkey * -2) AS lng1,
           radians(s.n_nationkey) AS lat2, radians(s.n_nationkey * -2) AS lng2
    FROM sales LEFT JOIN places c ON customer_city = c.city AND customer_state = c.state AND c.state <> 'ASIA'
    LEFT JOIN places s ON seller_city = s.city AND seller_state = s.state AND s.state <> 'ASIA')
SELECT order_item_key, is_same_state, round(2 * 6371.0088::DOUBLE * asin(sqrt(
           pow(sin((lat2 - lat1) / 2), 2) + cos(lat1) * cos(lat2) * pow(sin((lng2 - lng1) / 2), 2))), 3) AS distance_km
FROM ends"""


def _sales_by(key: str, name: str, table: str, value: str = VALUE) -> str:
    return f"""SELECT {key} AS {name}, count(DISTINCT order_id) AS orders, count(*) AS items,
       {money(f"sum({value})")} AS revenue, {money(f"sum({value})")} / count({value}) AS avg_item_value
FROM {table} GROUP BY 1"""


ORACLE["sales_summary"] = f"""WITH {ORDERS}, {ITEMS}, {SOLD}
{_sales_by("strftime(date_trunc('month', order_purchase_timestamp), '%Y-%m-%d')", "month_start_date", "sold")}"""

ORACLE["category_performance"] = f"""WITH {ORDERS}, {ITEMS}, {SOLD_WITH_CATEGORY}
{_sales_by("product_category_name", "product_category_name", "categorised")}"""

ORACLE["state_performance"] = f"""WITH {ALL_FOR_SALES}
{_sales_by("customer_state", "customer_state", "sales", "total_value")}"""

ORACLE["payment_method_performance"] = f"""WITH {ALL_FOR_SALES}
{_sales_by("payment_type", "payment_type", "sales", "total_value")}"""

ORACLE["delivery_performance"] = f"""WITH {ALL_FOR_FULFILLMENT}
SELECT customer_state, count(*) AS orders,
       CAST(sum(delivery_days_actual) AS DOUBLE) / nullif(count(delivery_days_actual), 0) AS avg_delivery_days,
       CAST(count(*) FILTER (WHERE is_late_delivery) AS DOUBLE) / nullif(count(delivery_days_actual), 0) AS late_rate,
       CAST(sum(review_score) AS DOUBLE) / count(review_score) AS avg_review_score
FROM fulfillment WHERE order_status = 'delivered' GROUP BY 1"""

ORACLE["zip_prefixes"] = f"""WITH {PLACES}, raw AS (
    SELECT CAST(c_nationkey AS VARCHAR) AS geolocation_zip_code_prefix,
           concat(' ', CAST(CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 0.01 AS DECIMAL(14,4)) AS VARCHAR), '  ') AS geolocation_lat,
           CAST(CAST(CAST(-c_acctbal AS DECIMAL(12,2)) * 0.01 AS DECIMAL(14,4)) AS VARCHAR) AS geolocation_lng,
           concat(' São ', upper(city), ' - ', c_mktsegment) AS geolocation_city,
           concat(lower(state), ' ') AS geolocation_state
    FROM customer JOIN places ON c_nationkey = n_nationkey)
SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY geolocation_zip_code_prefix
        ORDER BY geolocation_state, geolocation_city, geolocation_lat, geolocation_lng) AS rn FROM raw) r
WHERE rn = 1"""

ORACLE["quality_issues"] = f"""WITH {ORDERS}, {LINES}, {PAYMENTS}
SELECT 'unknown_customer' AS issue_type, 'orders' AS table_name, CAST(order_id AS VARCHAR) AS record_key FROM ords
WHERE order_id % 10 = 0 OR customer_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'delivered_before_purchase', 'orders', CAST(order_id AS VARCHAR) FROM ords
WHERE order_delivered_customer_date < order_purchase_timestamp
UNION ALL SELECT 'missing_id', 'orders', NULL FROM ords WHERE order_id IS NULL
UNION ALL SELECT 'duplicate_id', 'orders', CAST(order_id AS VARCHAR) FROM ords GROUP BY order_id HAVING count(*) > 1
UNION ALL SELECT 'negative_payment', 'order_payments', concat(order_id, '-', payment_sequential) FROM payments
WHERE payment_value < 0"""

# --- landing, streaming, build ---------------------------------------------------------------------------------

ORACLE["landed_customers"] = """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
       CASE WHEN c_custkey % 3 <> 0 THEN nullif(c_mktsegment, 'BUILDING') END AS market_segment, c_name,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation,
       CASE c_custkey % 3 WHEN 1 THEN 'day one/customers/p.csv' WHEN 2 THEN 'day two/customers/p.csv'
            ELSE 'day two/customers/q.csv' END AS source_folder,
       true AS has_checksum, true AS has_time, 'run-1' AS _ingestion_run_id
FROM customer"""

ORACLE["file_checksums"] = """WITH lines AS (
    SELECT s_nationkey % 5 AS r, concat_ws(',', s_suppkey, s_name, s_nationkey) AS v FROM supplier),
sums AS (
    SELECT r, count(*) AS n, sum(strlen(v) + 1) AS length,
           sum(CAST(CAST('0x' || substr(md5(v), 1, 15) AS UBIGINT) AS HUGEINT)) AS a,
           sum(CAST(CAST('0x' || substr(md5(v), 17, 15) AS UBIGINT) AS HUGEINT)) AS b
    FROM lines GROUP BY r)
SELECT 'r=' || r AS file, CAST(length AS BIGINT) AS length, md5(concat_ws('|', n, CAST(a AS HUGEINT), CAST(b AS HUGEINT))) AS checksum
FROM sums"""

ORACLE["second_ingest"] = """WITH kept AS (SELECT *, s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 AS later FROM supplier)
SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, CAST(s_nationkey AS VARCHAR) AS seller_zip_code_prefix,
       CASE WHEN later THEN upper(s_name) ELSE s_name END AS seller_city,
       CASE WHEN later THEN 'S2' ELSE 'S1' END AS seller_state, CAST(0 AS BIGINT) AS files_left,
       (SELECT count(*) FILTER (WHERE s_suppkey % 4 <> 0) + count(*) FILTER (WHERE later) FROM kept) AS rows_logged
FROM kept"""

ORACLE["incremental_ingest"] = f"""WITH {ORDERS}
SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
       CASE WHEN order_status = 'delivered' THEN order_status ELSE 're' || order_status END AS order_status,
       order_purchase_timestamp, order_approved_at, order_delivered_carrier_date, order_delivered_customer_date,
       order_estimated_delivery_date
FROM ords"""

ORACLE["stream_log"] = """
SELECT CAST(4 AS BIGINT) AS files, count(*) AS rows_logged, count(*) AS rows_staged, CAST(0 AS BIGINT) AS files_that_differ,
       CAST(4 AS BIGINT) AS run_ids
FROM customer"""

ORACLE["gated_ingest"] = """WITH n AS (SELECT count(*) AS n, count(DISTINCT (c_nationkey, c_acctbal)) AS kinds FROM customer)
SELECT s AS snapshot, CASE s WHEN '3 more' THEN 2 * n ELSE n END AS table_rows, CASE s WHEN '3 more' THEN '2' ELSE '0' END AS newest,
       kinds AS rows_kept_out
FROM n, (VALUES ('1 first'), ('2 fewer'), ('3 more')) v(s)"""


def _listed(layer: str, table: str, columns: dict[str, str], comments: dict[str, str], keys: tuple[str, ...] = ()) -> list[str]:
    names = {"bigint": "long", "int": "integer"}
    return [
        f"('{layer}', '{table}', {i}, '{c}', '{names.get(kind, kind)}', {str(c not in keys).lower()}, '{comments.get(c, '').replace(chr(39), chr(39) * 2)}')"
        for i, (c, kind) in enumerate(columns.items(), 1)
    ]


_STORED = [
    *_listed("bronze", "sellers", dict.fromkeys(SELLERS_SPEC.columns, "string"), {}),
    *_listed("silver", "customers", {**CUSTOMERS_SPEC.columns, UPDATED_AT: "timestamp"}, CUSTOMERS_SPEC.comments, CUSTOMERS_SPEC.keys),
    *_listed("gold", "mart_monthly_performance", {**MART_MONTHLY.columns, UPDATED_AT: "timestamp"}, MART_MONTHLY.comments, MART_MONTHLY.keys),
]
ORACLE["catalog_listing"] = f"""
SELECT * FROM (VALUES {", ".join(_STORED)}) v(layer, table_name, position, column_name, data_type, nullable, description)"""

ORACLE["layer_checks"] = """
SELECT 'tables_in_' || layer AS validation_name, layer AS layer_name, layer <> 'master' AS passed,
       CAST(CASE WHEN layer = 'master' THEN 1 ELSE 0 END AS BIGINT) AS issue_count
FROM (VALUES ('bronze'), ('silver'), ('gold'), ('master')) v(layer)"""

ORACLE["required_column_checks"] = """
SELECT 'columns_' || name AS validation_name, layer AS layer_name, n = 0 AS passed, CAST(n AS BIGINT) AS issue_count
FROM (VALUES ('sellers', 'bronze', 1), ('products', 'bronze', 0), ('orders', 'silver', 2),
             ('mart_monthly_performance', 'gold', 0)) v(name, layer, n)"""

ORACLE["quality_log"] = f"""
SELECT *, true AS has_time FROM ({ORACLE["warehouse_checks"]}) UNION ALL SELECT *, true FROM ({ORACLE["column_tests"]})"""

ORACLE["reused_result"] = """
SELECT c_mktsegment, count(*) AS customers, max(c_custkey) AS newest, true AS is_kept FROM customer GROUP BY 1"""

ORACLE["request_durations"] = """WITH runs AS (
    SELECT user_id, arg_max(event_type, (ts, event_id)) AS status,
           CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000 AS took
    FROM events GROUP BY user_id)
SELECT status, count(*) AS requests, round(avg(took), 3) AS avg_ms, quantile_disc(took, 0.95) AS p95_ms,
       count(took) <= 10000 AS p95_is_exact
FROM runs GROUP BY status"""

ORACLE["urban_places"] = f"""WITH {PLACES}, placed AS (
    SELECT city, state, n_nationkey, CAST(floor(n_nationkey * -2 / 4.0) AS BIGINT) AS cell_x,
           CAST(floor(n_nationkey / 4.0) AS BIGINT) AS cell_y
    FROM places),
living AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)
SELECT a.city, a.state, a.cell_x, a.cell_y, count(*) AS places_near, CAST(sum(ifnull(n, 0)) AS BIGINT) AS customers_near,
       sum(ifnull(n, 0)) >= (SELECT 2 * count(*) // 5 FROM customer) AS is_urban
FROM placed a JOIN placed b ON abs(a.cell_x - b.cell_x) <= 1 AND abs(a.cell_y - b.cell_y) <= 1
LEFT JOIN living ON c_nationkey = b.n_nationkey GROUP BY ALL"""

# --- contents of the warehouse after two builds ----------------------------------------------------------------

_LATER = """supplier AS (SELECT * REPLACE (CAST((s_nationkey + 1) % 25 AS INTEGER) AS s_nationkey) FROM supplier),
    orders AS (SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END
                                 AS o_orderstatus) FROM orders)"""


def _cleaned(name: str, key: str) -> str:
    return f"{name} AS (SELECT * REPLACE (CAST({key} AS BIGINT) AS {key}) FROM ({ORACLE[f'silver_{name}']}))"


def _model(spec: TableSpec) -> str:
    """The model over cleaned silver tables."""
    if spec.layer != "gold":
        return ORACLE[f"{spec.layer}_{spec.name}"]
    sql = ORACLE[spec.name]
    for raw, name, key in ((CUSTOMERS, "customers", "customer_id"), (SELLERS, "sellers", "seller_id"), (PRODUCTS, "products", "product_id")):
        sql = sql.replace(raw, _cleaned(name, key))
    return sql.replace("l_returnflag AS payment_type", "lower(l_returnflag) AS payment_type")


def _after(sql: str, tables: str) -> str:
    """The statement over tables that are defined before it."""
    sql = sql.strip()
    return f"WITH {tables}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {tables} {sql}"


def _second(spec: TableSpec) -> str:
    """Rows of the second build; the kept columns have their values of the first. Reviews are not landed again."""
    if spec.name == "order_reviews":
        return _model(spec)
    if not spec.kept:
        return _after(_model(spec), _LATER)
    on = " AND ".join(f"f.{k} = n.{k}" for k in spec.keys)
    kept = ", ".join(f"CASE WHEN f.{spec.keys[0]} IS NULL THEN n.{c} ELSE f.{c} END AS {c}" for c in spec.kept)
    return f"SELECT n.* REPLACE ({kept}) FROM ({_after(_model(spec), _LATER)}) n LEFT JOIN ({_model(spec)}) f ON {on}"


def _text(column: str, kind: str) -> str:
    if kind.startswith(("decimal", "double")):
        column = f"CAST(floor(CAST({column} AS DOUBLE) * 1000000 + 0.5) AS BIGINT)"
    elif kind.startswith("timestamp"):
        column = f"strftime({column}, '%Y-%m-%d %H:%M:%S')"
    return f"coalesce(CAST({column} AS VARCHAR), '~')"


def _digest(spec: TableSpec, build: int, rows: str) -> str:
    row = ", ".join(_text(c, kind) for c, kind in spec.columns.items())
    half = "sum(CAST(CAST('0x' || substr(h, {}, 15) AS UBIGINT) AS HUGEINT))"
    return f"""SELECT {build} AS build, '{spec.layer}.{spec.name}' AS table_name, count(*) AS row_count,
       md5(concat_ws('|', count(*), CAST({half.format(1)} AS HUGEINT), CAST({half.format(17)} AS HUGEINT))) AS digest
FROM (SELECT md5(concat_ws('|', {row})) AS h FROM ({rows}))"""


ORACLE["warehouse_build"] = "\nUNION ALL ".join(
    [_digest(m, 1, _model(m)) for m in MODELS] + [_digest(m, 2, _second(m)) for m in MODELS]
)
