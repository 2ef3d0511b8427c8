"""Column functions. All of them are built-in Spark expressions; none is a Python UDF."""

from orderloom.functions.casts import (
    parsed,
    to_decimal,
    to_int,
    to_ts,
)
from orderloom.functions.measures import (
    absolute_gap,
    days_between,
    exact_avg,
    finite_or_null,
    haversine_km,
    month_bucket,
    round_half_up_int,
    safe_divide,
    safe_growth,
    seconds_between,
    token_estimate,
)
from orderloom.functions.text import (
    as_column,
    blank_to_null,
    clean_place,
    composite_key,
    normalize_text,
    state_code,
    surrogate_key,
    title_case,
    trimmed,
)

__all__ = [
    "absolute_gap",
    "as_column",
    "blank_to_null",
    "clean_place",
    "composite_key",
    "days_between",
    "exact_avg",
    "finite_or_null",
    "haversine_km",
    "month_bucket",
    "normalize_text",
    "parsed",
    "round_half_up_int",
    "safe_divide",
    "safe_growth",
    "seconds_between",
    "state_code",
    "surrogate_key",
    "title_case",
    "to_decimal",
    "to_int",
    "to_ts",
    "token_estimate",
    "trimmed",
]
