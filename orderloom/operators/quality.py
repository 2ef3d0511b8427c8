"""Data-quality checks. Every check is a small DataFrame of (validation_name, layer_name, passed, issue_count)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.sources.rows import small_frame

RESULT_SCHEMA = "validation_name string, layer_name string, passed boolean, issue_count bigint"
REVENUE_TOLERANCE = "0.01"


def _verdict(issues: DataFrame, name: str, layer: str) -> DataFrame:
    """``issues`` is one row with a column ``issue_count``."""
    n = F.coalesce(F.col("issue_count"), F.lit(0)).cast("long")
    return issues.select(
        F.lit(name).alias("validation_name"),
        F.lit(layer).alias("layer_name"),
        (n == 0).alias("passed"),
        n.alias("issue_count"),
    )


def check_rows(df: DataFrame, layer: str, bad: Mapping[str, Column]) -> DataFrame:
    """Several row conditions over one table in one scan; each condition marks a bad row."""
    entries = [
        F.struct(F.lit(name).alias("validation_name"), F.count_if(is_bad).alias("n")) for name, is_bad in bad.items()
    ]
    counted = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    return counted.select(
        "validation_name",
        F.lit(layer).alias("layer_name"),
        (F.col("n") == 0).alias("passed"),
        F.col("n").cast("long").alias("issue_count"),
    )


def check_not_null(df: DataFrame, column: str, layer: str, name: str | None = None) -> DataFrame:
    return check_rows(df, layer, {name or f"not_null_{column}": F.col(column).isNull()})


def check_non_negative(df: DataFrame, column: str, layer: str, name: str | None = None) -> DataFrame:
    return check_rows(df, layer, {name or f"non_negative_{column}": F.col(column) < 0})


def check_unique(df: DataFrame, keys: Sequence[str], layer: str, name: str | None = None) -> DataFrame:
    """The issue count is the number of keys that occur more than once."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return _verdict(per_key.agg(F.count("*").alias("issue_count")), name or f"unique_{'_'.join(keys)}", layer)


def check_relationship(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, layer: str, name: str | None = None
) -> DataFrame:
    """The issue count is the number of child rows with a key that no parent row has (NULL keys pass)."""
    per_key = (
        child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    )
    orphans = per_key.join(parent.select(F.col(parent_key).alias("p")), F.col("k") == F.col("p"), "left_anti")
    return _verdict(orphans.agg(F.sum("n").alias("issue_count")), name or f"relationship_{child_key}", layer)


def check_reconcile(
    left: DataFrame, left_value: Column, right: DataFrame, right_value: Column, layer: str, name: str
) -> DataFrame:
    """Two totals must agree within a cent; a missing total is an issue."""
    sides = left.agg(F.sum(left_value).cast("decimal(38,4)").alias("l")).select(
        "l", F.lit(None).cast("decimal(38,4)").alias("r")
    )
    other = right.agg(F.sum(right_value).cast("decimal(38,4)").alias("r")).select(
        F.lit(None).cast("decimal(38,4)").alias("l"), "r"
    )
    gap = F.abs(F.max("l") - F.max("r"))
    close = F.coalesce(gap < F.lit(REVENUE_TOLERANCE).cast("decimal(18,4)"), F.lit(False))
    return _verdict(
        sides.unionByName(other).agg(F.when(close, F.lit(0)).otherwise(F.lit(1)).alias("issue_count")), name, layer
    )


MISSING = "~"


def canonical(column: str, kind: str) -> Column:
    """A value as text that any engine writes alike: numbers with a fraction as whole millionths, times to the second."""
    c = F.col(column)
    if kind.startswith(("decimal", "double", "float")):
        c = F.floor(c.cast("double") * 1_000_000 + 0.5).cast("long")
    elif kind.startswith("timestamp"):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def digest_halves(md5: Column) -> list[Column]:
    """The two halves of an md5 text, 15 hexadecimal digits of each, as columns of numbers for ``digest_sums``.

    To be selected before the sums: an aggregate that keeps texts besides works a half out anew for each sum of it.
    """
    return [F.conv(F.substring(md5, at, 15), 16, 10).cast("long").alias(f"__half{at}") for at in (1, 17)]


def digest_sums() -> list[Column]:
    """Sums over ``digest_halves``, for ``digest_of``.

    A half's 60 bits are summed as two numbers of 30, which are exact as longs up to 2^33 rows and cheaper than decimals.
    """
    out = []
    for at in (1, 17):
        half = F.col(f"__half{at}")
        out += [F.sum(F.shiftright(half, 30)).alias(f"__high{at}"), F.sum(half.bitwiseAND(F.lit((1 << 30) - 1))).alias(f"__low{at}")]
    return out


def digest_of(count: str) -> Column:
    """The md5 of a count of rows and their ``digest_sums``."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    half = lambda at: (wide(f"__high{at}") * F.lit(1 << 30).cast("decimal(10,0)") + wide(f"__low{at}")).cast("string")
    return F.md5(F.concat_ws("|", count, half(1), half(17)))


def content_digest(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row (row_count, digest) for the named columns (name: type), whatever the order of the rows.

    The digest is the md5 of the count and of two exact sums over the md5 of every row's canonical text.
    """
    row = F.md5(F.concat_ws("|", *[canonical(c, kind) for c, kind in columns.items()]))
    sums = df.select(*digest_halves(row)).agg(F.count("*").alias("row_count"), *digest_sums())
    return sums.select("row_count", digest_of("row_count").alias("digest"))


def check_columns(df: DataFrame, required: Sequence[str], layer: str, name: str) -> DataFrame:
    """The issue count is the number of required columns the table lacks."""
    missing = len(set(required) - set(df.columns))
    row = {"validation_name": name, "layer_name": layer, "passed": missing == 0, "issue_count": missing}
    return small_frame(df.sparkSession, [row], RESULT_SCHEMA)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of (table_name, actual)."""
    return union_all(
        df.agg(F.count("*").alias("actual")).select(F.lit(name).alias("table_name"), "actual")
        for name, df in tables.items()
    )


def yearly_counts(df: DataFrame, timestamp: str) -> DataFrame:
    """Rows per calendar year of a timestamp (or timestamp text)."""
    year = F.year(F.col(timestamp).cast("timestamp_ntz"))
    return df.groupBy(year.alias("year")).agg(F.count("*").alias("actual"))


def check_row_count(tables: Mapping[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Counts against expectations (table_name, row_count): (table_name, check, expected, actual, passed, status).

    status is ``compared``, ``skipped`` for a table without an expectation or ``missing`` for one that is expected
    and was not given; the last two have no verdict.
    """
    return _compare_counts(row_counts(tables).withColumn("check", F.lit("row_count")), expected)


def check_yearly_counts(df: DataFrame, timestamp: str, table_name: str, expected: DataFrame) -> DataFrame:
    """Counts per year against expectations (table_name, year, row_count)."""
    wanted = expected.filter(F.col("table_name") == table_name).select("table_name", "year", "row_count")
    joined = wanted.join(yearly_counts(df, timestamp), "year", "left")
    actual = F.coalesce(F.col("actual"), F.lit(0)).cast("long")
    return joined.select(
        "table_name",
        F.format_string("year_%d_count", F.col("year")).alias("check"),
        F.col("row_count").cast("long").alias("expected"),
        actual.alias("actual"),
        (actual == F.col("row_count")).alias("passed"),
        F.lit("compared").alias("status"),
    )


def _compare_counts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    joined = actual.join(expected.select("table_name", "row_count"), "table_name", "full_outer")
    status = F.when(F.col("row_count").isNull(), "skipped").when(F.col("actual").isNull(), "missing").otherwise("compared")
    return joined.select(
        "table_name",
        F.coalesce("check", F.lit("row_count")).alias("check"),
        F.col("row_count").cast("long").alias("expected"),
        F.col("actual").cast("long").alias("actual"),
        (F.col("actual") == F.col("row_count")).alias("passed"),
        status.alias("status"),
    )


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def total_issues(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.sum("issue_count"), F.lit(0)).cast("long").alias("issue_count"))


def growth_gate(new_counts: DataFrame, expected: DataFrame, cached: DataFrame) -> DataFrame:
    """Should a new snapshot replace the kept one? Rows of (table_name, new_rows, expected_rows, decision).

    ``new_counts``: (table_name, actual); ``expected``: (table_name, row_count); ``cached``: (table_name) of the
    snapshots already kept. No kept snapshot or more rows than expected: accept. Fewer rows: keep the old one and
    warn. Otherwise keep.
    """
    joined = (
        new_counts.join(expected.select("table_name", "row_count"), "table_name", "left")
        .join(cached.select("table_name", F.lit(True).alias("is_cached")).distinct(), "table_name", "left")
    )
    decision = (
        F.when(F.col("is_cached").isNull(), "accept")
        .when(F.col("actual") > F.col("row_count"), "accept")
        .when(F.col("actual") < F.col("row_count"), "warn_keep")
        .otherwise("keep")
    )
    return joined.select(
        "table_name",
        F.col("actual").cast("long").alias("new_rows"),
        F.col("row_count").cast("long").alias("expected_rows"),
        decision.alias("decision"),
    )


def grows(actual: int, expected: int | None) -> bool:
    """The same for one snapshot that is about to replace another: whether it has more rows than are expected."""
    return expected is None or actual > expected


def renew_expectations(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expectations (table_name, row_count, version) with observed counts; a change bumps the last version number."""
    joined = expected.join(observed.select("table_name", "actual"), "table_name", "left")
    changed = F.col("actual").isNotNull()
    parts = F.split("version", r"\.")
    bumped = F.concat_ws(
        ".", F.slice(parts, F.lit(1), F.size(parts) - 1), (F.element_at(parts, -1).cast("int") + 1).cast("string")
    )
    return joined.select(
        "table_name",
        F.coalesce("actual", "row_count").cast("long").alias("row_count"),
        F.when(changed, bumped).otherwise(F.col("version")).alias("version"),
    )


def expectations_frame(spark: SparkSession, rows: Mapping[str, int], version: str) -> DataFrame:
    return small_frame(
        spark,
        [{"table_name": name, "row_count": n, "version": version} for name, n in rows.items()],
        "table_name string, row_count bigint, version string",
    )
