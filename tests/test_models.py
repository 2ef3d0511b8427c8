"""Silver and gold models on hand-made rows, gold also against plain Python."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from orderloom import schemas as S
from orderloom.functions import to_decimal, to_int
from orderloom.plans import gold, silver

PLACES = [("sao paulo", "São Paulo", "SP"), ("dup", "One", "SP"), ("dup", "Two", "SP")]


def places(spark, rows=PLACES):
    return spark.createDataFrame(rows, "raw_city string, canonical_city string, state string")


def test_customers(spark):
    bronze = spark.createDataFrame(
        [
            (" c1 ", None, "01046", " sao paulo ", "sp"),
            ("c1", "a", "1", "x", "rj "),
            ("c2", "b", " ", "Nowhere", " mg"),
            ("c3", "c", "5", "dup", "sp"),
        ],
        "customer_id string, customer_unique_id string, customer_zip_code_prefix string, customer_city string, customer_state string",
    )
    got = {r["customer_id"]: tuple(r)[1:] for r in silver.customers(bronze, places(spark)).collect()}
    assert got["c1"] == ("a", 1, "x", "RJ")
    assert got["c2"] == ("b", None, "Nowhere", "MG")
    assert got["c3"] == ("c", 5, "One", "SP")


def test_sellers_repeat_with_an_ambiguous_map(spark):
    bronze = spark.createDataFrame(
        [("s1", "1046", "sao paulo", "SP"), ("s2", "1", "dup", "SP")],
        "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string",
    )
    got = sorted(tuple(r) for r in silver.sellers(bronze, places(spark)).collect())
    assert got == [("s1", 1046, "São Paulo", "SP"), ("s2", 1, "One", "SP"), ("s2", 1, "Two", "SP")]


def test_products_keep_a_blank_category(spark):
    columns = ["product_id", "product_category_name", "product_name_lenght", "product_description_lenght",
               "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]
    bronze = spark.createDataFrame(
        [("p1", " beleza ", "40.0", "2.5", None, "225.0", "16", "", "1"), ("p2", "  ", "", "", "", "", "", "", "")],
        ", ".join(f"{c} string" for c in columns),
    )
    mapping = spark.createDataFrame([("beleza", "beauty")], "raw_category string, canonical_category string")
    got = sorted(tuple(r) for r in silver.products(bronze, mapping).collect())
    assert got[0][:6] == ("p1", "beauty", 40, 3, None, Decimal("225.0000"))
    assert got[1][:3] == ("p2", "", None)


def test_orders_and_reviews(spark):
    stamp = "2017-10-02 10:56:33"
    bronze = spark.createDataFrame(
        [(" o1", "c1 ", " Delivered ", stamp, "", " ", None, "2017-10-18 00:00:00")],
        ", ".join(f"{c} string" for c in S.ORDERS.columns),
    )
    got = tuple(silver.orders(bronze).first())
    assert got == ("o1", "c1", "delivered", datetime(2017, 10, 2, 10, 56, 33), None, None, None, datetime(2017, 10, 18))
    reviews = spark.createDataFrame(
        [("r1", "o1", "4.0", " ", "two\nlines", stamp, stamp)], ", ".join(f"{c} string" for c in S.ORDER_REVIEWS.columns)
    )
    assert tuple(silver.order_reviews(reviews).first())[:5] == ("r1", "o1", 4, None, "two\nlines")


def test_bad_text_fails_or_is_set_aside(spark):
    bronze = spark.createDataFrame(
        [("o1", "1.0", "credit_card", "x", "9.90"), ("o2", "2.0", "boleto", "1", "")],
        ", ".join(f"{c} string" for c in S.ORDER_PAYMENTS.columns),
    )
    with pytest.raises(Exception, match="not a value of type"):
        silver.order_payments(bronze).collect()
    lenient = {r["order_id"]: r["payment_installments"] for r in silver.order_payments(bronze, strict=False).collect()}
    assert lenient == {"o1": None, "o2": 1}
    parsers = {
        "payment_installments": lambda c: to_int(c, strict=False),
        "payment_value": lambda c: to_decimal(c, strict=False),
    }
    assert [(r["order_id"], r["bad_columns"]) for r in silver.rejected_rows(bronze, parsers).collect()] == [
        ("o1", ["payment_installments"])
    ]


def test_geography(spark):
    bronze = spark.createDataFrame(
        [
            ("1", "-23.5", "-46.5", "são paulo", "sp"),
            ("1", " -23.7", "", "SAO PAULO - centro", "SP "),
            ("2", "1", "1", "- x", "SP"),
            ("2", "1", "1", None, "SP"),
        ],
        "zip string, geolocation_lat string, geolocation_lng string, geolocation_city string, geolocation_state string",
    )
    assert [tuple(r) for r in silver.geography(bronze).collect()] == [("Sao Paulo", "SP", -23.6, -46.5)]


# --- gold --------------------------------------------------------------------------------------------------

T0 = datetime(2018, 1, 31, 12)


def D(x):
    return None if x is None else Decimal(x)


@pytest.fixture(scope="module")
def tables(spark):
    """Orders with several items, several reviews, no items, no customer, unknown values and a hot order."""
    orders, items, payments, reviews = [], [], [], []
    for i in range(12):
        status = ["delivered", "delivered", "shipped", "canceled"][i % 4]
        bought = T0 + timedelta(days=17 * i, hours=i)
        arrived = None if i % 5 == 4 else bought + timedelta(days=i, hours=20)
        orders.append((f"o{i}", "missing" if i == 7 else f"c{i % 5}", status, bought, bought + timedelta(hours=30),
                       bought + timedelta(hours=10), arrived, None if i == 8 else bought + timedelta(days=5)))
        for n in range(0 if i == 3 else 30 if i == 1 else 1 + i % 3):
            price = None if (i, n) == (2, 0) else D(f"{10 + (7 * i + 3 * n) % 11}.50")
            items.append((f"o{i}", n + 1, f"p{(i + n) % 4}", f"s{(i * n) % 5}", price, D("1.25")))
        for n in range(i % 4):
            payments.append((f"o{i}", n + 1, f"type{n}", n, None if (i, n) == (2, 1) else D(f"{20 - n % 2}")))
        for n in range(i % 3):
            reviews.append((f"r{i}{n}", f"o{i}", None if (i, n) == (5, 0) else 1 + (i + 2 * n) % 5))
    make = spark.createDataFrame
    stamps = ", ".join(f"{c} timestamp_ntz" for c in list(S.ORDERS.columns)[3:])
    return {
        "orders": make(orders, f"order_id string, customer_id string, order_status string, {stamps}"),
        "items": make(items, "order_id string, order_item_id int, product_id string, seller_id string, "
                             "price decimal(18,4), freight_value decimal(18,4)"),
        "payments": make(payments, "order_id string, payment_sequential int, payment_type string, "
                                   "payment_installments int, payment_value decimal(18,4)"),
        "reviews": make(reviews, "review_id string, order_id string, review_score int"),
        "customers": make([(f"c{i}", f"u{i // 2}", f"city{i}", "SP") for i in range(5)],
                          "customer_id string, customer_unique_id string, customer_city string, customer_state string"),
        "sellers": make([(f"s{i}", f"city{i}", "RJ") for i in range(4)] + [("idle", "x", "RJ")],
                        "seller_id string, seller_city string, seller_state string"),
        "products": make([(f"p{i}", f"cat{i}", i, D(i), D(1), D(1), D(1)) for i in range(5)],
                         "product_id string, product_category_name string, product_photos_qty int, "
                         "product_weight_g decimal(18,4), product_length_cm decimal(18,4), "
                         "product_height_cm decimal(18,4), product_width_cm decimal(18,4)"),
    }


@pytest.fixture(scope="module")
def plain(tables):
    return {name: [r.asDict() for r in df.collect()] for name, df in tables.items()}


def mean(xs):
    xs = [float(x) for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def test_fact_sales_items(tables, plain):
    t = tables
    got = gold.fact_sales_items(t["items"], t["orders"], t["products"], t["sellers"], t["customers"], t["payments"])
    assert got.columns == list(S.FACT_SALES_ITEMS.columns)
    rows = {r["order_item_key"]: r for r in got.collect()}
    assert len(rows) == len(plain["items"])
    orders = {o["order_id"]: o for o in plain["orders"]}
    sellers = {s["seller_id"]: s for s in plain["sellers"]}
    for i in plain["items"]:
        r = rows[f"{i['order_id']}-{i['order_item_id']}"]
        paid = [p for p in plain["payments"] if p["order_id"] == i["order_id"]]
        paid.sort(key=lambda p: (p["payment_value"] is not None, -(p["payment_value"] or 0), p["payment_sequential"]))
        assert r["payment_type"] == (paid[0]["payment_type"] if paid else None)
        assert r["order_status"] == orders[i["order_id"]]["order_status"]
        assert r["seller_city"] == sellers.get(i["seller_id"], {}).get("seller_city")
        assert r["total_value"] == (None if i["price"] is None else i["price"] + i["freight_value"])
        assert (r["customer_city"] is None) == (r["customer_id"] == "missing")


def test_fact_order_fulfillment(tables, plain):
    t = tables
    got = gold.fact_order_fulfillment(t["orders"], t["customers"], t["reviews"], t["items"], t["sellers"])
    assert got.columns == list(S.FACT_ORDER_FULFILLMENT.columns)
    rows = {r["order_id"]: r for r in got.collect()}
    assert set(rows) == {o["order_id"] for o in plain["orders"]} - {"o7"}
    known = {s["seller_id"] for s in plain["sellers"]}

    def whole_days(a, b):
        return None if a is None or b is None else int((a - b) / timedelta(days=1))

    for o in plain["orders"]:
        if o["order_id"] == "o7":
            continue
        r = rows[o["order_id"]]
        items = [i for i in plain["items"] if i["order_id"] == o["order_id"] and i["seller_id"] in known]
        items.sort(key=lambda i: (i["price"] is not None, -(i["price"] or 0), i["order_item_id"]))
        assert r["seller_id"] == (items[0]["seller_id"] if items else None)
        score = mean(v["review_score"] for v in plain["reviews"] if v["order_id"] == o["order_id"])
        assert r["review_score"] == (None if score is None else int(score + 0.5))
        arrived, due = o["order_delivered_customer_date"], o["order_estimated_delivery_date"]
        assert r["is_late_delivery"] == (None if arrived is None or due is None else arrived > due)
        assert r["delivery_days_actual"] == whole_days(arrived, o["order_purchase_timestamp"])
        assert r["processing_days"] == whole_days(o["order_delivered_carrier_date"], o["order_approved_at"]) == 0


def test_mart_customer_behavior(tables, plain):
    got = gold.mart_customer_behavior(tables["customers"], tables["orders"], tables["items"])
    rows = {r["customer_unique_id"]: r for r in got.collect()}
    buyer = {c["customer_id"]: c["customer_unique_id"] for c in plain["customers"]}
    owner = {o["order_id"]: buyer.get(o["customer_id"]) for o in plain["orders"]}
    for u in {v for v in owner.values() if v}:
        items = [i for i in plain["items"] if owner[i["order_id"]] == u]
        values = [None if i["price"] is None else i["price"] + i["freight_value"] for i in items]
        r = rows.pop(u)
        assert (r["total_items_bought"], r["total_orders"]) == (len(items), len({i["order_id"] for i in items}))
        assert r["total_lifetime_value"] == sum(v for v in values if v is not None)
        assert r["avg_order_value"] == pytest.approx(mean(values))
        assert r["is_repeat_customer"] == (r["total_orders"] > 1)
    assert not rows


def test_mart_monthly_performance(tables, plain):
    got = gold.mart_monthly_performance(gold.sold_items(tables["items"], tables["orders"]))
    rows = {str(r["month_start_date"])[:7]: r for r in got.collect()}
    orders = {o["order_id"]: o for o in plain["orders"]}
    months = {}
    for i in plain["items"]:
        months.setdefault(str(orders[i["order_id"]]["order_purchase_timestamp"])[:7], []).append(i)
    assert set(rows) == set(months)
    for m, items in months.items():
        values = [None if i["price"] is None else i["price"] + i["freight_value"] for i in items]
        assert rows[m]["total_orders"] == len({i["order_id"] for i in items})
        assert rows[m]["total_customers"] == len({orders[i["order_id"]]["customer_id"] for i in items})
        assert rows[m]["total_revenue"] == sum(v for v in values if v is not None)
        assert rows[m]["avg_order_value"] == pytest.approx(mean(values))


@pytest.mark.parametrize("dimension", ["seller", "product"])
def test_performance_marts(tables, plain, dimension):
    t, key = tables, f"{dimension}_id"
    if dimension == "seller":
        got = gold.mart_seller_performance(t["sellers"], t["items"], t["orders"], t["reviews"])
    else:
        got = gold.mart_product_performance(t["products"], t["items"], t["orders"], t["reviews"])
    rows = {r[key]: r for r in got.collect()}
    assert set(rows) == {d[key] for d in plain[f"{dimension}s"]}
    orders = {o["order_id"]: o for o in plain["orders"]}
    for k, r in rows.items():
        items = [i for i in plain["items"] if i[key] == k]
        sold = [i for i in items if orders[i["order_id"]]["order_status"] == "delivered"]
        # Every item meets every review of its order.
        scores = [v["review_score"] for i in items for v in plain["reviews"] if v["order_id"] == i["order_id"]]
        assert r["avg_review_score"] == pytest.approx(mean(scores) or 0.0)
        assert r["total_revenue"] == sum(i["price"] for i in sold if i["price"] is not None)
        if dimension == "product":
            assert r["total_units_sold"] == len(sold)
            assert r["avg_price"] == pytest.approx(mean(i["price"] for i in sold) or 0.0)
            continue
        assert (r["total_items_sold"], r["total_orders"]) == (len(sold), len({i["order_id"] for i in sold}))
        timed = [orders[i["order_id"]] for i in sold]
        timed = [o for o in timed if o["order_delivered_customer_date"] and o["order_estimated_delivery_date"]]
        late = [o for o in timed if o["order_delivered_customer_date"] > o["order_estimated_delivery_date"]]
        assert r["late_delivery_rate"] == pytest.approx(len(late) / len(timed) if timed else 0.0)
        first = min((orders[i["order_id"]]["order_purchase_timestamp"] for i in sold), default=None)
        assert r["active_since"] == first
    idle = rows["idle" if dimension == "seller" else "p4"]
    assert idle["total_revenue"] == 0 and idle["avg_review_score"] == 0.0


def test_conform_checks_columns_and_keeps_comments(spark):
    df = spark.createDataFrame([("s", "1", "c", "SP")], "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string")
    assert S.SELLERS.conform(df).dtypes[1] == ("seller_zip_code_prefix", "int")
    with pytest.raises(ValueError, match="lacks"):
        S.SELLERS.conform(df.drop("seller_city"))
    fact = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in S.FACT_SALES_ITEMS.columns.items()))
    assert S.FACT_SALES_ITEMS.conform(fact).schema["total_value"].metadata["comment"]


def test_update_lists():
    assert S.MART_MONTHLY.update_cols == ["total_revenue", "total_orders", "total_customers"]
    assert S.FACT_ORDER_FULFILLMENT.update_cols == [
        "order_status", "order_delivered_customer_date", "is_late_delivery", "review_score"
    ]
    assert S.MART_CUSTOMER.update_cols == ["latest_purchase_at", "total_orders", "total_lifetime_value", "is_repeat_customer"]
    assert S.MART_PRODUCT.update_cols == ["total_revenue", "total_units_sold", "avg_review_score"]
    assert S.MART_SELLER.update_cols == [
        "total_revenue", "total_orders", "total_items_sold", "avg_review_score", "late_delivery_rate"
    ]
    assert len(S.FACT_SALES_ITEMS.update_cols) == 14


def test_required_columns(spark):
    from orderloom.plans import checks

    raw = spark.createDataFrame([], ", ".join(f"{checks.RAW_SPELLING.get(c, c)} string" for c in S.PRODUCTS.columns))
    got = {r["validation_name"]: (r["layer_name"], r["issue_count"]) for r in checks.required_columns({"products": raw}).collect()}
    assert got == {"columns_products": ("silver", 2)}
    landed = checks.required_columns({"products": raw, "sellers": raw}, landed=True).collect()
    assert {r["validation_name"]: r["passed"] for r in landed} == {"columns_products": True, "columns_sellers": False}
