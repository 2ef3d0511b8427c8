"""Text to typed values.

``strict=True`` fails the job on text that does not parse, whatever the session's ANSI setting; ``strict=False``
gives NULL, so that a caller can count or set aside the rows that failed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions.text import ColumnLike, blank_to_null

WIDE_DECIMAL = "decimal(38,10)"


def _checked(text: Column, value: Column, kind: str, strict: bool, fits: Column | None = None) -> Column:
    """The value, or a failure where there is text but no value (or one that does not fit)."""
    bad = text.isNotNull() & (value.isNull() if fits is None else value.isNull() | ~fits)
    if not strict:
        return value if fits is None else F.when(~bad, value)
    message = F.concat(F.lit(f"not a value of type {kind}: "), text.cast("string"))
    return F.when(bad, F.raise_error(message).cast(kind)).otherwise(value)


def parsed(text: Column, kind: str, strict: bool = True) -> Column:
    """Text without blanks as a value of a type."""
    return _checked(text, text.try_cast(kind), kind, strict)


def to_decimal(c: ColumnLike, precision: int = 18, scale: int = 4, strict: bool = True) -> Column:
    """Text to a decimal. Text with more decimal places than the type holds does not parse: nothing is rounded."""
    text = blank_to_null(c)
    kind = f"decimal({precision},{scale})"
    value = text.try_cast(kind)
    return _checked(text, value, kind, strict, value == text.try_cast("decimal(38,18)"))


def to_int(c: ColumnLike, strict: bool = True, allow_fraction: bool = True, kind: str = "int") -> Column:
    """Text to integer through a decimal, so ``'1.0'`` parses; halves round away from zero.

    ``allow_fraction=False`` takes whole numbers only, as a direct cast to integer does.
    """
    text = blank_to_null(c)
    if not allow_fraction:
        return parsed(text, kind, strict)
    return _checked(text, F.round(text.try_cast(WIDE_DECIMAL)).try_cast(kind), kind, strict)


def to_ts(c: ColumnLike, fmt: str | None = None, strict: bool = True) -> Column:
    """Text to a timestamp without zone; with ``fmt`` the text must have exactly that pattern."""
    text = blank_to_null(c)
    if fmt is not None:
        # The lenient parser is for zoned timestamps and moves a time that the session zone skips;
        # it only tells which texts fit the pattern.
        fits = F.try_to_timestamp(text, F.lit(fmt)).isNotNull()
        value = F.to_timestamp_ntz(F.when(fits, text), F.lit(fmt))
        return _checked(text, value, "timestamp_ntz", strict)
    return parsed(text, "timestamp_ntz", strict)
