"""Text rules: case- and trailing-blank-insensitive equality, blanks, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: str | Column) -> Column:
    """True for NULL, '' and all-blank text."""
    return F.trim(F.coalesce(col(c).cast("string"), F.lit(""))) == ""


def text_key(c: str | Column) -> Column:
    """Comparison key: equality of keys is case- and trailing-blank-insensitive equality."""
    return F.lower(F.rtrim(col(c)))


def contains_text(c: str | Column, term: str) -> Column:
    """Case-insensitive 'contains', with the term taken literally."""
    return F.lower(col(c)).contains(term.strip().lower())


def distinct_list(c: str | Column, sep: str = ",") -> Column:
    """Aggregate: distinct values in ascending order, joined.

    ``collect_set`` de-duplicates map-side, so only distinct values travel.
    NULL when the group has no value, as a string aggregate gives.
    """
    joined = F.array_join(F.sort_array(F.collect_set(col(c))), sep)
    return F.when(F.count(col(c)) > 0, joined)


def int_or_null(c: str | Column) -> Column:
    return col(c).cast("string").try_cast("int")


def number_or_null(c: str | Column) -> Column:
    return col(c).cast("string").try_cast("decimal(18,4)")


def date_or_null(c: str | Column) -> Column:
    return col(c).cast("string").try_cast("date")
