import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderloom.operators import profile, quality, results
from orderloom.operators.lookup import fuzzy_top_k
from orderloom.operators.quantiles import describe_values, exact_quantiles


def test_payment_sequences(spark):
    rows = [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 1), (3, 1), (3, 2), (4, 1), (4, None), (5, None)]
    df = spark.createDataFrame(rows, "k int, s int")
    verdicts = {r["k"]: r["is_contiguous"] for r in profile.sequence_verdicts(df, "k", "s").collect()}
    assert verdicts == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {r["k"] for r in profile.sequence_gaps(df, "k", "s").collect()} == {2, 3, 4, 5}


def test_groups_with_repeats(spark):
    df = spark.createDataFrame([(1, "c"), (1, "c"), (1, "v"), (2, "c"), (3, "v"), (3, "v")], "k int, t string")
    got = profile.groups_with_repeats(df, "k", F.col("t") == "c")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "c"), (1, "c"), (1, "v")]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50).map(lambda n: n / 4), min_size=1, max_size=30))
def test_quantiles_interpolate(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
    got = {r["probability"]: r["value"] for r in exact_quantiles(df, "x", (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    ordered = sorted(xs)
    for p, value in got.items():
        at = p * (len(xs) - 1)
        low, high = ordered[int(at)], ordered[min(int(at) + (at > int(at)), len(xs) - 1)]
        assert value == pytest.approx(low + (high - low) * (at - int(at)))
    assert len(got) == 5


def test_describe(spark):
    rng = random.Random(7)
    xs = [rng.gauss(0, 1000) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r["stat"]: r["value"] for r in describe_values(df, "x").collect()}
    assert got["count"] == 500 and got["min"] == min(xs) and got["max"] == max(xs)
    assert got["mean"] == pytest.approx(statistics.fmean(xs)) and got["std"] == pytest.approx(statistics.stdev(xs))
    quartiles = statistics.quantiles(xs, n=4, method="inclusive")
    assert [got["25%"], got["50%"], got["75%"]] == pytest.approx(quartiles)


def test_describe_of_nothing(spark):
    got = {r["stat"]: r["value"] for r in describe_values(spark.createDataFrame([], "x double"), "x").collect()}
    assert got["count"] == 0 and got["mean"] is None and "50%" not in got


def test_profile_and_examples(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (2, "a" * 60)], "n int, t string")
    got = {r["column_name"]: r for r in profile.profile(df).collect()}
    assert got["n"]["approx_distinct"] == 2 and got["t"]["null_count"] == 1 and got["n"]["max_value"] == "2"
    assert profile.example_values(df, ["n"]).first()["examples"] == ["b"]
    assert profile.table_columns(df)[0]["type"] == "int"


def test_profile_of_nested_columns(spark, folder):
    got = {r["column_name"]: r for r in profile.profile(spark.read.parquet(f"{folder}/embeddings.parquet")).collect()}
    assert got["embedding"]["null_count"] == 0 and got["embedding"]["min_value"] is None


def test_distinct_counts_ignore_null(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (2, "a")], "n int, t string")
    assert {tuple(r) for r in profile.distinct_counts(df, ["n", "t"]).collect()} == {("n", 2), ("t", 2)}


def test_fuzzy_names(spark):
    df = spark.createDataFrame([("rio de janeiro",), ("rio de janeiro",), ("rio d janeiro",), ("",), (None,)], "c string")
    got = [tuple(r) for r in fuzzy_top_k(df, "c", "rio de janeiro", 2).collect()]
    assert got[0] == ("rio de janeiro", 1.0) and got[1][0] == "rio d janeiro"


def test_checks(spark):
    df = spark.createDataFrame([(1, -1.0), (1, 2.0), (None, None)], "k int, v double")

    def verdict(frame):
        return tuple(frame.first())[2:]

    assert verdict(quality.check_not_null(df, "k", "silver")) == (False, 1)
    assert verdict(quality.check_unique(df, ["k"], "silver")) == (False, 1)
    assert verdict(quality.check_non_negative(df, "v", "silver")) == (False, 1)
    parent = spark.createDataFrame([(2,)], "p int")
    assert verdict(quality.check_relationship(df, "k", parent, "p", "silver")) == (False, 2)
    assert verdict(quality.check_columns(df, ["k", "x", "y"], "silver", "columns")) == (False, 2)
    assert verdict(quality.check_relationship(df.limit(0), "k", parent, "p", "silver")) == (True, 0)


@pytest.mark.parametrize("left, right, issues", [(1.0, 1.005, 0), (1.0, 1.02, 1), (None, 1.0, 1), (None, None, 1)])
def test_reconcile(spark, left, right, issues):
    a = spark.createDataFrame([(left,)], "v double").withColumn("v", F.col("v").cast("decimal(18,4)"))
    b = spark.createDataFrame([(right,)], "w double").withColumn("w", F.col("w").cast("decimal(18,4)"))
    got = quality.check_reconcile(a, F.col("v"), b, F.col("w"), "gold", "sales").first()
    assert got["issue_count"] == issues and got["passed"] == (issues == 0)


def test_growth_gate(spark):
    new = spark.createDataFrame([("a", 5), ("b", 11), ("c", 9), ("d", 10), ("e", 1)], "table_name string, actual bigint")
    expected = quality.expectations_frame(spark, {t: 10 for t in "abcd"}, "1.0.0")
    cached = spark.createDataFrame([(t,) for t in "bcde"], "table_name string")
    got = {r["table_name"]: r["decision"] for r in quality.growth_gate(new, expected, cached).collect()}
    assert got == {"a": "accept", "b": "accept", "c": "warn_keep", "d": "keep", "e": "keep"}


def test_renewed_expectations(spark):
    old = quality.expectations_frame(spark, {"a": 1, "b": 2}, "1.1.0")
    seen = spark.createDataFrame([("a", 7)], "table_name string, actual bigint")
    got = {tuple(r) for r in quality.renew_expectations(old, seen).collect()}
    assert got == {("a", 7, "1.1.1"), ("b", 2, "1.1.0")}


def test_row_and_year_expectations(spark):
    orders = spark.createDataFrame([("2017-01-01 00:00:00",), ("2018-05-05 10:00:00",), (None,)], "ts string")
    expected = quality.expectations_frame(spark, {"orders": 3, "other": 1}, "1.0.0")
    got = quality.check_row_count({"orders": orders, "unknown": orders}, expected).collect()
    assert {r["table_name"]: (r["expected"], r["actual"], r["passed"], r["status"]) for r in got} == {
        "orders": (3, 3, True, "compared"), "unknown": (None, 3, None, "skipped"), "other": (1, None, None, "missing")
    }
    years = spark.createDataFrame([("orders", 2016, 0), ("orders", 2017, 2)], "table_name string, year int, row_count bigint")
    got = {r["check"]: (r["actual"], r["passed"]) for r in quality.check_yearly_counts(orders, "ts", "orders", years).collect()}
    assert got == {"year_2016_count": (0, True), "year_2017_count": (1, False)}


def test_multi_series_fixture(spark):
    rows = [("2018-01", "health", 100), ("2018-02", "watches", 120), ("2018-01", "health", 5)]
    df = spark.createDataFrame(rows, "purchase_month string, category string, revenue bigint")
    wide = results.multi_series(df, ["health", "watches"])
    got = {r["purchase_month"]: (r["health"], r["watches"], r["other"]) for r in wide.collect()}
    assert got == {"2018-01": (105, 0, 0), "2018-02": (0, 120, 0)}
    got = {r["purchase_month"]: (r["health"], r["other"]) for r in results.multi_series(df, ["health"]).collect()}
    assert got == {"2018-01": (105, 0), "2018-02": (0, 120)}
    long = {tuple(r) for r in results.series_totals(df).collect()}
    assert long == {("2018-01", "health", 105), ("2018-02", "watches", 120)}
    plain = df.select("category", "revenue")
    assert results.multi_series(plain, ["health"]) is plain and results.series_totals(plain) is plain
    with pytest.raises(ValueError, match="differ"):
        results.multi_series(df, ["health", "other"])


def test_bounded_sql_and_reuse(spark):
    spark.range(1000).createOrReplaceTempView("many_rows")
    assert results.bounded_sql(spark, "SELECT * FROM many_rows").count() == 100
    assert results.bounded_sql(spark, "SELECT * FROM many_rows LIMIT 7", 50).count() == 7
    assert results.bounded_sql(spark, "SELECT * FROM many_rows LIMIT 300").count() == 300
    assert results.bounded_sql(spark, "SELECT * FROM (SELECT * FROM many_rows LIMIT 300)").count() == 100
    assert results.bounded_sql(spark, "SELECT * FROM {rows}", rows=spark.range(5)).count() == 5
    one = results.reused_sql(spark, "SELECT * FROM many_rows LIMIT 3")
    assert results.reused_sql(spark, " SELECT * FROM many_rows LIMIT 3 ") is one and one.count() == 3
    results.forget_results()
    assert results.reused_sql(spark, "SELECT * FROM many_rows LIMIT 3") is not one
    with pytest.raises(ValueError):
        results.bounded_sql(spark, "SELECT * FROM many_rows", 501)
    kept = results.reuse(spark.sql("SELECT count(*) AS n FROM many_rows"))
    assert kept.first()["n"] == 1000
    again = spark.sql("SELECT count(*) AS n FROM many_rows")
    assert "InMemoryTableScan" in again._jdf.queryExecution().toString()
    kept.unpersist()


def test_sanitize_leaves_other_columns(spark):
    df = spark.createDataFrame([("x", None, float("nan"))], "name string, value int, f double")
    assert tuple(results.sanitize(df).first()) == ("x", None, None)


def test_buckets_follow_the_data(spark):
    """Nearly all values lie close together; no bucket has more than a few times the mean all the same."""
    from orderloom.operators.quantiles import BUCKETS, _counted_values

    close = spark.range(50_000).select((F.col("id") / 1e9).alias("x"))
    far = spark.range(50).select((F.col("id") * 1e6 + 1e3).alias("x"))
    sizes = _counted_values(close.union(far), F.col("x")).groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) < 4 * 50_050 / BUCKETS and len(sizes) > BUCKETS / 2
