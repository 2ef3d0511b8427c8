"""Exact quantiles, a describe() summary and a global rank that no single task has to hold.

``percentile`` keeps a map of every distinct value in one aggregation buffer, and a window without a partition
key sorts the table in one task. Here the input is counted per distinct value, which collapses hot values map-side.
The values fall into ``BUCKETS`` buckets of about as many distinct values each; the few bucket counts are accumulated,
and positions are found inside single buckets. What is found is exact wherever the buckets' bounds lie, so these may
be estimates: a scalar subquery of the same plan, over the same counted values. Every step reads the one exchange of
the counted values, so the input is computed once and no job runs before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS = 8
BUCKETS = 1 << STEPS


def _counted_values(df: DataFrame, value: Column, whole_rows: bool = False) -> DataFrame:
    """(bucket, start, value, n): each distinct value once, NULL left out; start is near the bucket's values.

    whole_rows: read all columns as well, so that what lies below the counting is the same as for the rows
    themselves, and Spark computes it once for both.
    """
    measures = [F.count("*").alias("n")]
    kept = df.select(value.alias("value"))
    if whole_rows:
        kept = df.select(value.alias("value"), F.xxhash64(*df.columns).alias("row"))
        measures.append(F.max("row").alias("row"))
    counted = kept.filter(F.col("value").isNotNull()).groupBy("value").agg(*measures)
    if whole_rows:
        counted = counted.filter(F.col("row").isNotNull()).drop("row")
    at = F.col("value").cast("double")
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    # The count is named here as well: a column less would be another exchange.
    bounds = counted.filter(F.col("n") > 0).agg(F.percentile_approx(at, shares, 20 * BUCKETS).alias("bounds")).scalar()
    placed = counted.withColumn("bounds", bounds).withColumn("bucket", F.lit(0))
    for step in reversed(range(STEPS)):  # how many bounds lie below the value, by halving
        below = F.get("bounds", F.col("bucket") + ((1 << step) - 1)) < at
        placed = placed.withColumn("bucket", F.col("bucket") + F.when(below, 1 << step).otherwise(0))
    start = F.get("bounds", F.least("bucket", F.lit(BUCKETS - 2)))
    return placed.select("bucket", start.alias("start"), "value", "n")


def _quantiles(counted: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    # One row per bucket; the global window runs over these few rows only.
    sized = counted.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    placed = sized.select("bucket", "n", F.coalesce(before, F.lit(0)).alias("before"), total.alias("total"))

    wanted = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("p"),
                F.lit(side).alias("side"),
                rank(F.lit(float(p)) * (F.col("total") - 1)).cast("long").alias("rank"),
            )
            for p in probabilities
            for side, rank in (("low", F.floor), ("high", F.ceil))
        ]
    )
    inside = F.filter(wanted, lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("n")))
    targets = placed.select("bucket", "before", "total", F.explode(inside).alias("w")).select(
        "bucket", "total", "w.p", "w.side", (F.col("w.rank") - F.col("before")).alias("rank_in_bucket")
    )

    # Positions of the values inside the wanted buckets. Not a semi join: that would be pushed below the
    # counting, whose result could then not be used again.
    near = counted.join(targets.select("bucket").distinct(), "bucket")
    upto = F.sum("n").over(W.partitionBy("bucket").orderBy("value"))
    ranged = near.select("bucket", "value", (upto - F.col("n")).alias("first"), upto.alias("end"))
    hits = ranged.join(targets, "bucket").filter(
        (F.col("rank_in_bucket") >= F.col("first")) & (F.col("rank_in_bucket") < F.col("end"))
    )
    ends = hits.groupBy("p").agg(
        F.max(F.when(F.col("side") == "low", F.col("value"))).alias("low"),
        F.max(F.when(F.col("side") == "high", F.col("value"))).alias("high"),
        F.max("total").alias("total"),
    )
    position = F.col("p") * (F.col("total") - 1)
    fraction = position - F.floor(position)
    return ends.select(
        F.col("p").alias("probability"),
        (F.col("low") + (F.col("high") - F.col("low")) * fraction).alias("value"),
    )


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """Quantiles with linear interpolation between neighbours: rows of (probability, value)."""
    return _quantiles(_counted_values(df, F.col(column).cast("double")), probabilities)


def _moments(counted: DataFrame) -> DataFrame:
    """One row of count, mean, std, min, max.

    Sums are taken of the offsets inside each bucket, and the buckets are put together around the overall
    mean, so large values far from zero do not cancel out.
    """
    start = F.col("start")
    offset = F.col("value") - start
    per_bucket = counted.groupBy("bucket").agg(
        F.max("start").alias("start"),
        F.sum("n").alias("n"),
        F.sum(offset * F.col("n")).alias("s"),
        F.sum(offset * offset * F.col("n")).alias("q"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    everything = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    centred = per_bucket.select(
        "*",
        F.sum("n").over(everything).alias("total"),
        (F.sum(start * F.col("n") + F.col("s")).over(everything) / F.sum("n").over(everything)).alias("mean"),
    )
    shift = F.col("mean") - start
    spread = F.sum(F.col("q") - 2 * shift * F.col("s") + F.col("n") * shift * shift)
    return centred.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("count"),
        F.max("mean").alias("mean"),
        F.sqrt(F.try_divide(spread, F.max("total") - 1)).alias("std"),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
    )


def describe_values(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max as rows of (stat, value); the input is computed once."""
    counted = _counted_values(df, F.col(column).cast("double"))
    stats = ["count", "mean", "std", "min", "max"]
    basics = _moments(counted).unpivot([], stats, "stat", "value")
    quartiles = _quantiles(counted, (0.25, 0.5, 0.75)).select(
        F.format_string("%d%%", (F.col("probability") * 100).cast("int")).alias("stat"), "value"
    )
    return basics.unionByName(quartiles)


def global_rank(df: DataFrame, metric: str, output: str) -> DataFrame:
    """Rank of every row by a metric, highest first, equal values sharing a rank (RANK without a partition).

    NULL metrics get no rank. All columns of ``df`` are read for the ranks too, so give those that are wanted.
    """
    counted = _counted_values(df, F.col(metric), whole_rows=True)
    sized = counted.groupBy("bucket").agg(F.sum("n").alias("size"))
    higher = F.sum("size").over(W.orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1))
    placed = sized.select("bucket", F.coalesce(higher, F.lit(0)).alias("higher"))
    inside = F.sum("n").over(
        W.partitionBy("bucket").orderBy(F.col("value").desc()).rowsBetween(W.unboundedPreceding, -1)
    )
    ranks = (
        counted.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(placed, "bucket")
        .select(
            F.col("value").alias("__ranked"), (F.col("higher") + F.col("inside") + 1).cast("long").alias(output)
        )
    )
    return df.join(ranks, F.col(metric) == F.col("__ranked"), "left").drop("__ranked")
