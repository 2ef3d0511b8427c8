"""Every registered query against its SQL counterpart, and the shape of the plans."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_file
from orderloom.catalog import QUERIES
from orderloom.catalog_sql import ORACLE as SQL
from orderloom.sources.standins import Silver

@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_file.queries()) and set(SQL) <= set(entry_file.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con, SQL[name]) == []


def test_entry(spark):
    assert entry_file.entry(spark).count() > 0


# --- plans ---------------------------------------------------------------------------------------------------

WRITING = {"catalog_listing", "gated_ingest", "layer_checks", "quality_log", "stream_log", "csv_round_trip", "landed_customers", "incremental_ingest", "warehouse_build", "file_checksums", "second_ingest"}
LAZY = sorted(set(QUERIES) - WRITING)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as for tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", LAZY)
def test_no_plan_pairs_all_rows_or_leaves_the_jvm(spark, folder, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, folder))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "BroadcastHashJoin"):
        assert bad not in plan


def test_first_row_per_key_is_cut_before_the_shuffle(spark, folder):
    plan = plan_of(Silver(spark, folder).lines)
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


@pytest.mark.parametrize(
    "name, exchanges",
    [
        ("fact_sales_items", 20),
        ("fact_order_fulfillment", 17),
        ("mart_customer_behavior", 10),
        ("mart_monthly_performance", 5),
        ("mart_seller_performance", 12),
        ("mart_product_performance", 7),
        ("merge_upsert", 2),
        ("total_revenue", 4),
    ],
)
def test_number_of_shuffles(spark, folder, no_broadcast, name, exchanges):
    """Up to eight of them belong to the tiny nation and region tables and to the line item clean-up."""
    plan = plan_of(QUERIES[name](spark, folder))
    assert plan.count("Exchange") <= exchanges, plan


def test_scans_read_only_the_columns_they_need(spark, folder):
    plan = plan_of(QUERIES["review_by_state"](spark, folder))
    assert "l_extendedprice" not in plan and "l_tax" not in plan
    plan = plan_of(QUERIES["total_revenue"](spark, folder))
    assert "o_totalprice" not in plan and "c_name" not in plan


def test_filters_reach_the_scan(spark, folder):
    plan = plan_of(QUERIES["merge_upsert"](spark, folder))
    assert "Not(EqualTo(o_orderstatus,P))" in plan and "Not(EqualTo(o_orderstatus,F))" in plan
