"""How many rows an action reads from files, by Spark's own record of its stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


def _stages(spark: SparkSession) -> dict[int, int]:
    jvm, context = spark._jvm, spark._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    none, no_shares = jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(jvm.double, 0)
    found = context.statusStore().stageList(none, False, False, no_shares, none)
    return {(s := found.apply(i)).stageId(): s.inputRecords() for i in range(found.size())}


def rows_read(spark: SparkSession, action: Callable[[], object]) -> int:
    before = _stages(spark)
    action()
    return sum(n for stage, n in _stages(spark).items() if stage not in before)
