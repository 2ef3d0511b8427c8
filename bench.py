"""Headline queries, wall seconds each, as one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1). BENCH_CPUS: local cores (default 8).
Every query runs to the end into the no-op sink, so no column of its result is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from orderloom.catalog import QUERIES  # noqa: E402
from orderloom.session import local_session  # noqa: E402

HEADLINE = (
    "fact_sales_items",
    "fact_order_fulfillment",
    "mart_customer_behavior",
    "mart_monthly_performance",
    "mart_seller_performance",
    "mart_product_performance",
    "silver_customers",
    "silver_orders",
    "silver_order_items",
    "master_geography",
    "merge_upsert",
    "dedupe_first",
    "monthly_growth",
    "delivery_delays",
    "top_states",
    "category_revenue",
    "warehouse_checks",
    "column_tests",
    "sequence_gaps",
    "interval_summary",
    "distinct_counts",
    "text_functions",
    "seller_features",
    "pivot_sum",
    "csv_round_trip",
)


def run(name: str, spark, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "orderloom-bench")
    # Start-up costs (class loading, first code generation) belong to no query.
    run("fact_sales_items", spark, folder)
    seconds = {name: round(run(name, spark, folder), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cores),
            }
        )
    )


if __name__ == "__main__":
    main()
