"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_RANK = "__rank"


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of each key in the given order.

    ``order`` must spell out where NULLs go and should be a total order, because Spark, unlike the
    SQL standard default, sorts NULL first on ascending columns. The ``rank = 1`` filter lets Catalyst
    put a partial ``WindowGroupLimit`` below the exchange: each map task ships one row per key, so a
    key that holds a third of the table costs one row per map task in the shuffle.
    """
    ranked = df.withColumn(_RANK, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(_RANK) == 1).drop(_RANK)


def rows_of_repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > 1).select(*keys)
    return df.join(repeated, list(keys), "left_semi")


def surplus_row_count(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier, entirely equal row (one row, column ``surplus_rows``).

    Texts are compared by their SHA-256, so that whole texts do not move.
    """
    keys = [
        F.unhex(F.sha2(F.col(c).cast("binary"), 256)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes
    ]
    per_row = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    return per_row.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("surplus_rows"))
