"""Numbers and dates: rates, averages, month buckets, day counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions.text import ColumnLike, as_column

EARTH_RADIUS_KM = 6371.0088


def month_bucket(c: ColumnLike) -> Column:
    return F.trunc(as_column(c).cast("date"), "MM")


def days_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Whole days of ``later - earlier``, cut toward zero (-1.5 days gives -1).

    ``datediff`` would count calendar midnights instead.
    """
    return F.extract(F.lit("DAY"), as_column(later) - as_column(earlier)).cast("int")


def seconds_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Signed seconds of ``later - earlier`` as a double, microseconds kept."""
    gap = as_column(later) - as_column(earlier)
    whole = (
        F.extract(F.lit("DAY"), gap).cast("long") * 86400
        + F.extract(F.lit("HOUR"), gap).cast("long") * 3600
        + F.extract(F.lit("MINUTE"), gap).cast("long") * 60
    )
    return whole.cast("double") + F.extract(F.lit("SECOND"), gap).cast("double")


def safe_growth(current: ColumnLike, previous: ColumnLike) -> Column:
    """(current - previous) / previous as a double; NULL if previous is 0 or NULL."""
    cur, prev = as_column(current), as_column(previous)
    return F.when(prev != 0, (cur - prev).cast("double") / prev.cast("double"))


def safe_divide(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double"))


def exact_avg(total: ColumnLike, count: ColumnLike) -> Column:
    """Average from an exact (decimal or integer) sum and a count; NULL for an empty group."""
    return safe_divide(total, count)


def round_half_up_int(c: ColumnLike) -> Column:
    return F.round(as_column(c)).cast("int")


def absolute_gap(a: ColumnLike, b: ColumnLike) -> Column:
    return F.abs(as_column(a) - as_column(b))


def token_estimate(c: ColumnLike) -> Column:
    """About four characters per token."""
    return F.floor(F.length(as_column(c)) / 4).cast("long")


def finite_or_null(c: ColumnLike) -> Column:
    """NaN and the two infinities become NULL."""
    x = as_column(c)
    infinite = F.abs(x) == F.lit(float("inf"))
    return F.when(~(F.isnan(x) | infinite), x)


def haversine_km(lat1: ColumnLike, lng1: ColumnLike, lat2: ColumnLike, lng2: ColumnLike) -> Column:
    """Great-circle distance in kilometres between two points given in degrees."""
    phi1, phi2 = F.radians(as_column(lat1)), F.radians(as_column(lat2))
    half_dphi = (phi2 - phi1) / 2
    half_dlambda = (F.radians(as_column(lng2)) - F.radians(as_column(lng1))) / 2
    h = F.pow(F.sin(half_dphi), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_dlambda), 2)
    # Not least(h, 1): that skips NULL.
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))
