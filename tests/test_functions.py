import hashlib
import math
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderloom import functions as fn


def values(spark, rows, ddl, *columns):
    df = spark.createDataFrame(rows, ddl)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_blank_to_null(spark):
    got = values(spark, [("",), ("  ",), (" x ",), (None,)], "a string", fn.blank_to_null("a"))
    assert got == [(None,), (None,), ("x",), (None,)]


def test_only_spaces_are_trimmed(spark):
    assert values(spark, [("\t x ",)], "a string", fn.trimmed("a")) == [("\t x",)]


def test_case_functions(spark):
    got = values(spark, [(" Delivered ", " sp"), (None, None)], "a string, b string", fn.normalize_text("a"), fn.state_code("b"))
    assert got == [("delivered", "SP"), (None, None)]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("SÃO PAULO - SP", "Sao Paulo"),
        ("rio (centro)", "Rio"),
        ("santa bárbara d'oeste", "Santa Barbara D'Oeste"),
        ("  ", ""),
        ("-x", ""),
        (None, None),
        ("são joão-del rei", "Sao Joao"),
        ("4º centenário", "4º Centenario"),
        ("ßeta straße", "ßeta Straße"),
    ],
)
def test_clean_place(spark, raw, clean):
    assert values(spark, [(raw,)], "a string", fn.clean_place("a")) == [(clean,)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcXYZéÑß019 '-./\n\t\u0001", max_size=12), min_size=1, max_size=8))
def test_title_case_matches_its_definition(spark, texts):
    def expected(text):
        out, fresh = [], True
        for ch in text.lower():
            out.append(ch.upper() if fresh and len(ch.upper()) == 1 else ch)
            fresh = not ch.isalnum()
        return "".join(out)

    got = values(spark, [(t,) for t in texts], "a string", fn.title_case("a"))
    assert got == [(expected(t),) for t in texts]


def test_text_to_integer(spark):
    rows = [("1.0",), ("4.5",), ("-4.5",), (" 7 ",), ("",), (None,)]
    assert values(spark, rows, "a string", fn.to_int("a")) == [(1,), (5,), (-5,), (7,), (None,), (None,)]


def test_text_to_integer_strict_and_lenient(spark):
    assert values(spark, [("abc",), ("99999999999",)], "a string", fn.to_int("a", strict=False)) == [(None,), (None,)]
    with pytest.raises(Exception, match="not a value of type"):
        values(spark, [("abc",)], "a string", fn.to_int("a"))
    with pytest.raises(Exception, match="not a value of type"):
        values(spark, [("1.5",)], "a string", fn.to_int("a", allow_fraction=False))


def test_text_to_decimal(spark):
    got = values(spark, [(" 12.50 ",), ("",)], "a string", fn.to_decimal("a"))
    assert str(got[0][0]) == "12.5000" and got[1] == (None,)
    assert values(spark, [("x",)], "a string", fn.to_decimal("a", strict=False)) == [(None,)]


def test_text_to_timestamp(spark):
    fmt = "yyyy-MM-dd HH:mm:ss"
    rows = [("2017-01-01 10:00:00",), ("bad",), ("2017-01-01",), ("",)]
    when = datetime(2017, 1, 1, 10)
    assert values(spark, rows, "a string", fn.to_ts("a", fmt, strict=False)) == [(when,), (None,), (None,), (None,)]
    with pytest.raises(Exception, match="not a value of type timestamp_ntz: bad"):
        values(spark, [("bad",)], "a string", fn.to_ts("a", fmt))
    with pytest.raises(Exception, match="not a value of type"):
        values(spark, [("bad",)], "a string", fn.to_ts("a"))


def test_days_are_cut_toward_zero(spark):
    rows = [
        (datetime(2024, 1, 1), datetime(2024, 1, 2, 12)),
        (datetime(2024, 1, 3, 23), datetime(2024, 1, 1)),
        (None, datetime(2024, 1, 1)),
    ]
    got = values(spark, rows, "a timestamp_ntz, b timestamp_ntz", fn.days_between("a", "b"), fn.seconds_between("a", "b"))
    assert got == [(-1, -129600.0), (2, 255600.0), (None, None)]


def test_month_bucket(spark):
    got = values(spark, [(datetime(2018, 2, 28, 23, 59),)], "a timestamp_ntz", fn.month_bucket("a").cast("string"))
    assert got == [("2018-02-01",)]


def test_growth_and_ratio(spark):
    rows = [(100.0, 0.0), (100.0, None), (120.0, 100.0)]
    got = values(spark, rows, "c double, p double", fn.safe_growth("c", "p"), fn.safe_divide("c", "p"))
    assert got == [(None, None), (None, None), (0.2, 1.2)]


def test_keys(spark):
    got = values(spark, [(1, None), (1, "a")], "a int, b string", fn.surrogate_key("a", "b"), fn.composite_key("a", "b"))
    assert got == [(hashlib.md5(b"1|").hexdigest(), None), (hashlib.md5(b"1|a").hexdigest(), "1-a")]


def test_finite_or_null(spark):
    rows = [(math.nan,), (math.inf,), (-math.inf,), (1.5,), (None,)]
    assert values(spark, rows, "a double", fn.finite_or_null("a")) == [(None,), (None,), (None,), (1.5,), (None,)]


def test_token_estimate(spark):
    assert values(spark, [("abcdefgh",), ("abc",), ("ãããã",)], "a string", fn.token_estimate("a")) == [(2,), (0,), (1,)]


def test_distance(spark):
    rows = [(-23.55, -46.63, -22.91, -43.17), (1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 180.0)]
    got = values(spark, rows, "a double, b double, c double, d double", F.round(fn.haversine_km("a", "b", "c", "d")))
    assert got == [(361.0,), (0.0,), (None,), (20015.0,)]


def test_timestamps_without_zone_ignore_the_session_zone(spark):
    """Midnight of 1996-10-06 does not exist in this zone."""
    text, fmt = "1996-10-06 00:00:00", "yyyy-MM-dd HH:mm:ss"
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        got = values(spark, [(text,)], "a string", *[c.cast("string") for c in (fn.to_ts("a", fmt), fn.to_ts("a"), fn.to_ts("a", fmt, strict=False))])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(text, text, text)]
