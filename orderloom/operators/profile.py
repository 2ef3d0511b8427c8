"""Profiling of raw tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions import to_ts
from orderloom.operators.dedupe import rows_of_repeated_keys
from orderloom.operators.quantiles import describe_values

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
EXAMPLE_ROWS = 20
EXAMPLE_VALUES = 5
EXAMPLE_LENGTH = 50


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls, approximate distinct values, minimum and maximum as text.

    All columns are measured in one scan; the wide one-row result is then turned on its side.
    """
    entries = []
    for field in df.schema.fields:
        c = F.col(field.name)
        simple = field.dataType.simpleString()
        comparable = not simple.startswith(("array", "map", "struct", "binary"))
        counted = c if comparable else F.xxhash64(c)
        shown = _shown(simple)
        entries.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(simple).alias("data_type"),
                F.count("*").alias("row_count"),
                F.count_if(c.isNull()).alias("null_count"),
                F.approx_count_distinct(F.when(c.isNotNull(), counted)).alias("approx_distinct"),
                (shown(F.min(c)) if comparable else F.lit(None).cast("string")).alias("min_value"),
                (shown(F.max(c)) if comparable else F.lit(None).cast("string")).alias("max_value"),
            )
        )
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def _shown(kind: str) -> Callable[[Column], Column]:
    """How a value of a type is written: times to the second, fractions to two places, the rest as it is cast."""
    if kind.startswith("timestamp"):
        return lambda c: F.date_format(c, TIMESTAMP_FORMAT)
    if kind in ("double", "float"):
        return lambda c: c.cast("decimal(18,2)").cast("string")
    return lambda c: c.cast("string")


def example_values(df: DataFrame, keys: Sequence[str], rows: int = EXAMPLE_ROWS) -> DataFrame:
    """Up to five short example values per text column from the first rows in key order (column_name, examples)."""
    texts = [c for c, t in df.dtypes if t == "string"]
    sets = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.slice(
                F.sort_array(F.collect_set(F.when(F.length(c) < EXAMPLE_LENGTH, F.col(c)))), 1, EXAMPLE_VALUES
            ).alias("examples"),
        )
        for c in texts
    ]
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(rows).select(*texts).agg(F.array(*sets).alias("e")).select(F.inline("e"))


def table_columns(df: DataFrame) -> list[dict[str, object]]:
    """Name, type, nullability and description of each column, from the schema alone."""
    return [
        {
            "name": f.name,
            "type": f.dataType.simpleString(),
            "nullable": f.nullable,
            "description": f.metadata.get("comment", ""),
        }
        for f in df.schema.fields
    ]


_FIELDS = "struct<fields: array<struct<name: string, type: string, nullable: boolean, metadata: struct<comment: string>>>>"


def catalog(tables: DataFrame) -> DataFrame:
    """One row for each column of each stored table, from the schemas that the store keeps; no data is read.

    ``tables``: (layer, table_name, data_schema) as the store lists them. Rows: layer, table_name, position (from 1),
    column_name, data_type, nullable, description (empty without one). A nested type is given as its JSON text.
    """
    fields = F.from_json("data_schema", _FIELDS)["fields"]
    each = tables.select("layer", "table_name", F.posexplode(fields).alias("at", "f"))
    return each.select(
        "layer",
        "table_name",
        (F.col("at") + 1).alias("position"),
        F.col("f.name").alias("column_name"),
        F.col("f.type").alias("data_type"),
        F.col("f.nullable").alias("nullable"),
        F.coalesce("f.metadata.comment", F.lit("")).alias("description"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct values per column (rows: column_name, n_distinct).

    Each column is stacked into (name, value) pairs and made distinct by hash, so no column needs a
    pass of its own and a hot value collapses before the shuffle.
    """
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])))
    pairs = stacked.groupBy("column_name", "value").agg(F.lit(1).alias("one"))
    return pairs.groupBy("column_name").agg(F.count("value").alias("n_distinct"))


def approx_distinct_counts(df: DataFrame, columns: Sequence[str], rsd: float = 0.02) -> DataFrame:
    """HyperLogLog estimate per column in one scan without a shuffle of the values."""
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.approx_count_distinct(c, rsd).alias("n_distinct")) for c in columns
    ]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def parse_report(df: DataFrame, columns: Sequence[str], fmt: str = TIMESTAMP_FORMAT) -> DataFrame:
    """Per column: missing before and after a lenient timestamp parse, and how many became invalid."""
    entries = []
    for c in columns:
        before = F.count_if(F.col(c).isNull())
        after = F.count_if(to_ts(c, fmt, strict=False).isNull())
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"),
                before.alias("before_na"),
                after.alias("after_na"),
                (after - before).alias("new_invalid"),
            )
        )
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def order_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule, all rules in one scan (rows: rule, violations)."""
    entries = [
        F.struct(F.lit(name).alias("rule"), F.count_if(broken).alias("violations")) for name, broken in rules.items()
    ]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def date_order_rules() -> dict[str, Column]:
    """The five ways in which an order's dates can contradict each other."""
    purchase, approved = F.col("order_purchase_timestamp"), F.col("order_approved_at")
    carrier, delivered = F.col("order_delivered_carrier_date"), F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    return {
        "approved_before_purchase": approved < purchase,
        "carrier_before_approved": carrier < approved,
        "delivered_before_carrier": delivered < carrier,
        "estimated_before_purchase": estimated < purchase,
        "delivered_after_estimated": delivered > estimated,
    }


def interval_summary(df: DataFrame, seconds: Column, condition: Column) -> DataFrame:
    """describe() of a time gap in seconds over the rows that meet a condition."""
    gaps = df.filter(condition).select(seconds.alias("gap"))
    return describe_values(gaps, "gap")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows_of_repeated_keys(df, keys)


def sequence_verdicts(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Per key: does ``seq`` run 1, 2, ... n without gap or repeat? (columns: key, is_contiguous)

    Values are counted per (key, seq) first, so a key with very many rows is spread over tasks.
    """
    per_value = df.groupBy(key, seq).agg(F.count("*").alias("__n"))
    per_key = per_value.groupBy(key).agg(
        F.sum("__n").alias("__rows"),
        F.count(seq).alias("__values"),
        F.min(seq).alias("__min"),
        F.max(seq).alias("__max"),
    )
    contiguous = (
        (F.col("__rows") == F.col("__values")) & (F.col("__min") == 1) & (F.col("__max") == F.col("__values"))
    )
    return per_key.select(key, F.coalesce(contiguous, F.lit(False)).alias("is_contiguous"))


def sequence_gaps(df: DataFrame, key: str, seq: str) -> DataFrame:
    """All rows of the keys whose sequence is broken."""
    broken = sequence_verdicts(df, key, seq).filter(~F.col("is_contiguous")).select(key)
    return df.join(broken, key, "left_semi")


def groups_with_repeats(df: DataFrame, key: str, condition: Column, more_than: int = 1) -> DataFrame:
    """All rows of the keys that have more than ``more_than`` rows meeting the condition."""
    flagged = (
        df.filter(condition).groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > more_than).select(key)
    )
    return df.join(flagged, key, "left_semi")
