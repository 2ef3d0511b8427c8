"""Text functions: blanks, case, place names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Accented letters in place names and the letters that replace them.
ACCENTED = "áàâãéêíóôõúç"
UNACCENTED = "aaaaeeiooouc"


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: ColumnLike) -> Column:
    """Text without leading and trailing spaces (spaces only, as in SQL TRIM)."""
    return F.trim(as_column(c).cast("string"))


def blank_to_null(c: ColumnLike) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def normalize_text(c: ColumnLike) -> Column:
    return F.lower(trimmed(c))


def state_code(c: ColumnLike) -> Column:
    return F.upper(trimmed(c))


def title_case(c: ColumnLike) -> Column:
    """Upper-case every letter that follows a non-alphanumeric character, lower-case the rest.

    Spark's ``initcap`` only looks at spaces, so ``d'oeste`` would keep its small o.
    """

    def capitalise(word: Column) -> Column:
        first = word.substr(1, 1)
        upper = F.upper(first)
        # A letter without a one-letter capital (ß) stays as it is.
        return F.concat(F.when(F.length(upper) <= 1, upper).otherwise(first), word.substr(F.lit(2), F.length(word)))

    words = F.split(F.lower(as_column(c)), r"(?<=[^\p{L}\p{N}])")
    return F.array_join(F.transform(words, capitalise), "")


def clean_place(c: ColumnLike) -> Column:
    """Canonical place name: no district suffix or bracketed note, no accents, title case."""
    name = F.split_part(F.split_part(as_column(c).cast("string"), F.lit("-"), F.lit(1)), F.lit("("), F.lit(1))
    return title_case(F.trim(F.translate(F.lower(name), ACCENTED, UNACCENTED)))


def surrogate_key(*columns: ColumnLike) -> Column:
    """md5 over the text of the columns joined with ``|``; NULL counts as empty text."""
    parts = [F.coalesce(as_column(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def composite_key(*columns: ColumnLike) -> Column:
    """Readable key ``a-b``; NULL if any part is NULL."""
    parts: list[Column] = []
    for c in columns:
        if parts:
            parts.append(F.lit("-"))
        parts.append(as_column(c).cast("string"))
    return F.concat(*parts)
