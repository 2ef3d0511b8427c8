import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orderloom.operators.dedupe import dedupe_first, rows_of_repeated_keys, surplus_row_count
from orderloom.operators.lookup import lookup, match_count
from orderloom.operators.merge import cast_like, merge_upsert
from pyspark.sql import functions as F

DDL = "k int, a string, b string"


def frame(spark, rows, ddl=DDL):
    return spark.createDataFrame(rows, ddl)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matched_inserted_and_kept_rows(spark):
    target = frame(spark, [(1, "t", "t"), (2, "t", "t")])
    source = frame(spark, [(2, "s", "s"), (3, "s", "s")])
    assert rows_of(merge_upsert(target, source, ["k"], ["a"])) == [(1, "t", "t"), (2, "s", "t"), (3, "s", "s")]
    assert rows_of(merge_upsert(target, source, ["k"])) == [(1, "t", "t"), (2, "s", "s"), (3, "s", "s")]


def test_null_values_overwrite(spark):
    merged = merge_upsert(frame(spark, [(1, "t", "t")]), frame(spark, [(1, None, None)]), ["k"], ["a"])
    assert rows_of(merged) == [(1, None, "t")]


def test_duplicate_and_null_keys_fail(spark):
    target = frame(spark, [(1, "t", "t")])
    with pytest.raises(Exception, match="duplicate merge key: 2"):
        merge_upsert(target, frame(spark, [(2, "x", "x"), (2, "x", "x")]), ["k"]).collect()
    with pytest.raises(Exception, match="NULL in merge key"):
        merge_upsert(target, frame(spark, [(None, "x", "x")]), ["k"]).collect()
    with pytest.raises(Exception, match="NULL in merge key"):
        merge_upsert(target, frame(spark, [(None, "x", "x")]), ["k"], source_is_unique=True).collect()


def test_duplicates_fail_even_when_only_counted(spark):
    target = frame(spark, [(1, "t", "t")])
    with pytest.raises(Exception, match="duplicate merge key"):
        merge_upsert(target, frame(spark, [(2, "x", "x"), (2, "y", "x")]), ["k"]).count()


def test_unequal_columns_are_refused(spark):
    with pytest.raises(ValueError, match="equal columns"):
        merge_upsert(frame(spark, []), frame(spark, [], "k int, a string"), ["k"])
    with pytest.raises(ValueError, match="cannot update"):
        merge_upsert(frame(spark, []), frame(spark, []), ["k"], ["k"])


def test_merging_twice_changes_nothing(spark):
    target = frame(spark, [(1, "t", "t"), (2, "t", "t")])
    source = frame(spark, [(2, "s", "s"), (3, "s", "s")])
    once = merge_upsert(target, source, ["k"], ["a"])
    assert rows_of(merge_upsert(once, source, ["k"], ["a"])) == rows_of(once)


def test_two_part_keys(spark):
    ddl = "k int, l string, v int"
    target, source = frame(spark, [(1, "x", 1), (1, "y", 2)], ddl), frame(spark, [(1, "y", 9), (2, "y", 3)], ddl)
    assert rows_of(merge_upsert(target, source, ["k", "l"])) == [(1, "x", 1), (1, "y", 9), (2, "y", 3)]


unique_rows = st.dictionaries(st.integers(0, 9), st.tuples(st.sampled_from("abc"), st.none() | st.sampled_from("xy")), max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(unique_rows, unique_rows)
def test_merge_matches_a_dictionary_update(spark, old, new):
    expected = {k: (new[k][0], v[1]) if k in new else v for k, v in old.items()}
    expected.update({k: v for k, v in new.items() if k not in old})
    target = frame(spark, [(k, *v) for k, v in old.items()])
    source = frame(spark, [(k, *v) for k, v in new.items()])
    assert rows_of(merge_upsert(target, source, ["k"], ["a"])) == sorted(((k, *v) for k, v in expected.items()), key=str)


def test_cast_like(spark):
    target = spark.createDataFrame([], "i int, n bigint, d double, m decimal(18,2), s string")
    source = frame(spark, [("3.0", "4.5", "", "1.25", "x")], "i string, n string, d string, m string, s string")
    got = cast_like(source, target)
    assert got.dtypes == target.dtypes
    assert [str(v) for v in got.first()] == ["3", "5", "None", "1.25", "x"]


def test_dedupe_prefers_known_values(spark):
    df = frame(spark, [(1, None, "p"), (1, "a", "q"), (2, "b", "r")])
    got = dedupe_first(df, ["k"], [F.col("a").asc_nulls_last()])
    assert rows_of(got) == [(1, "a", "q"), (2, "b", "r")]


def test_repeated_keys_and_surplus(spark):
    df = frame(spark, [(1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (1, "b", "x"), (None, "n", "x"), (None, "n", "x")])
    assert len(rows_of(rows_of_repeated_keys(df, ["k"]))) == 3
    assert surplus_row_count(df).first()[0] == 2
    assert surplus_row_count(df.limit(0)).first()[0] == 0


def test_lookup_falls_back_and_refuses_ambiguity(spark):
    df = frame(spark, [(1,), (2,), (None,)], "c int")
    one = frame(spark, [(1, "one")], "code int, name string")
    fallback = F.concat(F.lit("#"), F.col("c").cast("string"))
    got = lookup(df, one, {"code": F.col("c")}, "name", "label", fallback)
    assert rows_of(got) == [(1, "one"), (2, "#2"), (None, None)]
    two = frame(spark, [(1, "one"), (1, "uno")], "code int, name string")
    with pytest.raises(Exception, match="more than one entry for 1"):
        lookup(df, two, {"code": F.col("c")}, "name", "label", fallback).collect()


def test_match_count(spark):
    child = frame(spark, [(1,), (1,), (2,), (None,)], "c int")
    parent = frame(spark, [(1,), (1,), (3,), (None,)], "p int")
    assert tuple(match_count(child, "c", parent, "p").first()) == (4, 2)
