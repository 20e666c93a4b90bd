"""Type-shape predicates and conservative physical types of raw text values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms of date-time text. ISO basic dates and ISO week dates count; a bare year does not.
DATETIME = (
    r"^(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(-[1-7])?)"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?([Zz]|[+-]\d{2}:?\d{2})?)?$"
)
INT = r"^[+-]?\d+$"
LEADING_ZERO = r"^[+-]?0\d+$"
FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def is_int(c: Column) -> Column:
    """Optional sign and digits."""
    return F.trim(c).rlike(INT)


def has_leading_zero(c: Column) -> Column:
    """More than one digit, the first a zero, sign aside."""
    return F.trim(c).rlike(LEADING_ZERO)


def is_float(c: Column) -> Column:
    """A decimal number that has a point or an exponent; nan and inf do not count."""
    t = F.trim(c)
    return t.rlike(FLOAT) & t.rlike("[.eE]")


def is_datetime(c: Column) -> Column:
    """ISO date or date-time text whose date part is a real day."""
    t = F.trim(c)
    day = F.coalesce(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    basic = F.regexp_replace(F.regexp_extract(t, r"^(\d{8})", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    some = F.when(day != "", day).otherwise(basic)
    return t.rlike(DATETIME) & (t.rlike("^\\d{4}-W") | F.try_to_date(some, "yyyy-MM-dd").isNotNull())


def physical_type(values: Column, weight: Column | None = None) -> Column:
    """Aggregate: conservative type of all non-blank values. No values: string; any leading zero: string."""
    some = F.trim(F.coalesce(values, F.lit(""))) != ""
    every = lambda p: F.coalesce(F.bool_and(F.when(some, p)), F.lit(False))
    return (
        F.when(F.coalesce(F.bool_or(F.when(some, has_leading_zero(values))), F.lit(False)), "string")
        .when(every(is_datetime(values)), "datetime")
        .when(every(is_int(values)), "int")
        .when(every(is_int(values) | is_float(values)), "float")
        .otherwise("string")
    )
