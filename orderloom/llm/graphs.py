"""Connected components by alternating large and small stars.

Every step is a minimum per node (combined map-side) joined back to the links, so a node with very many links
is split like any other skewed join. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import written


def _stars(links: DataFrame, both_ways: bool) -> DataFrame:
    """Links (a, b) with a > b. Large star: a's larger neighbours move to a's least one; small star: the smaller."""
    if both_ways:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links
    least = around.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    joined = around.join(least, "a")
    if both_ways:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("least").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link (a, b), root being the least node that it reaches, itself left out.

    Links may repeat and go either way; loops and NULL ends are ignored. Without links there are no rows.
    """
    now = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = written(now, "links"), None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(mark) == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(mark)
        now = written(_stars(_stars(now, True), False), "links")
