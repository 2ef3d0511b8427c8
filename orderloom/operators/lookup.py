"""Code-to-value lookups, membership and nearest names.

No join here carries a broadcast hint: Spark broadcasts a map whose measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and sort-merges a larger one, where adaptive execution
splits a hot key on the fact side.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODE = "__code"
_VALUE = "__value"
_N = "__n"


def lookup(
    df: DataFrame, mapping: DataFrame, on: Mapping[str, Column], value: str, output: str, fallback: Column
) -> DataFrame:
    """Add ``output``: the mapped ``value``, or ``fallback`` where the map has no entry.

    ``on`` gives the map column and the expression on ``df`` it must equal. Two entries for one code
    fail the job, as a scalar subquery that returns two rows does.
    """
    codes = list(on)
    per_code = mapping.groupBy(*codes).agg(F.first(value).alias(_VALUE), F.count("*").alias(_N))
    ambiguous = F.raise_error(
        F.concat(F.lit("more than one entry for "), F.concat_ws(", ", *[F.col(c).cast("string") for c in codes]))
    )
    single = per_code.select(
        *[F.col(c).alias(f"{_CODE}_{c}") for c in codes],
        F.when(F.col(_N) == 1, F.col(_VALUE)).otherwise(ambiguous.cast("string")).alias(_VALUE),
    )
    condition = F.lit(True)
    for c in codes:
        condition = condition & (on[c] == F.col(f"{_CODE}_{c}"))
    joined = df.join(single, condition, "left")
    return joined.withColumn(output, F.coalesce(F.col(_VALUE), fallback)).drop(
        _VALUE, *[f"{_CODE}_{c}" for c in codes]
    )


def match_count(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """How many child rows have a parent (one row: ``rows``, ``matched_rows``).

    The child is first counted per key, so the join sees each key once on both sides.
    """
    per_key = child.groupBy(F.col(child_key).alias("__k")).agg(F.count("*").alias(_N))
    parents = parent.select(F.col(parent_key).alias("__p")).filter(F.col("__p").isNotNull()).distinct()
    joined = per_key.join(parents, F.col("__k") == F.col("__p"), "left")
    return joined.agg(
        F.coalesce(F.sum(_N), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("__p").isNotNull(), F.col(_N))), F.lit(0)).cast("long").alias("matched_rows"),
    )


def name_similarity(name: Column, query: Column) -> Column:
    """1 - edit distance / longer length: 1.0 for equal names, 0.0 for nothing in common."""
    longest = F.greatest(F.length(name), F.length(query))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(name, query).cast("double") / longest.cast("double")
    )


def fuzzy_top_k(df: DataFrame, column: str, query: str, k: int = 20) -> DataFrame:
    """The ``k`` distinct names most similar to ``query``; equal scores in name order."""
    names = df.select(F.col(column).alias("name")).filter(F.col("name").isNotNull()).distinct()
    scored = names.withColumn("similarity", name_similarity(F.col("name"), F.lit(query)))
    return scored.orderBy(F.col("similarity").desc(), F.col("name").asc()).limit(k)
