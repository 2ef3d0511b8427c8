"""Figures per key from items: distinct orders without a map of all orders."""

from decimal import Decimal

from orderloom.plans import order_facts as facts

DDL = "order_id bigint, product_category_name string, total_value decimal(19,4)"


def test_orders_are_sorted_and_not_held(spark):
    rows = [(1, "a", 2), (1, "a", 3), (1, "b", 5), (2, "a", None), (None, "a", 7), (None, "a", 1), (3, None, 11), (3, None, 2)]
    items = spark.createDataFrame([(o, c, None if v is None else Decimal(v)) for o, c, v in rows], DDL)
    found = facts.category_performance(items)
    got = {r[0]: (r["orders"], r["items"], int(r["revenue"]), float(r["avg_item_value"])) for r in found.collect()}
    assert got == {"a": (2, 5, 13, 3.25), "b": (1, 1, 5, 5.0), None: (1, 2, 13, 6.5)}
    assert found.columns == ["product_category_name", "orders", "items", "revenue", "avg_item_value"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[order_id" not in plan and "SortAggregate(key=[order_id" in plan
