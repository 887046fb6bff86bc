"""Row field normalisation: text, dates, numbers and presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted text forms.
INTEGER_FORM = r"^\s*[+-]?\d+\s*$"
NUMERIC_FORM = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_FORM = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"
EMAIL_FORM = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)*$"
MONEY = "decimal(12,2)"
WHITESPACE = " \t\n\r\0\x0b"


def trimmed(value: Column) -> Column:
    return F.trim(value, F.lit(WHITESPACE))


def blank_to_null(value: Column) -> Column:
    return F.nullif(trimmed(value), F.lit(""))


def trim_strings(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Trim every text column and turn blanks into NULL, in one projection."""
    return df.select(
        *[
            blank_to_null(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) and f.name not in skip
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def dedup_key(value: Column) -> Column:
    """Trimmed key; a blank key counts as no key."""
    return blank_to_null(value)


def to_utc(value: Column) -> Column:
    """ISO date or timestamp text to a whole-second UTC timestamp; bad or blank text is NULL."""
    return F.date_trunc("second", blank_to_null(value).try_cast("timestamp"))


def is_date(value: Column) -> Column:
    return value.rlike(DATE_FORM) & value.try_cast("timestamp").isNotNull()


def is_integer(value: Column) -> Column:
    return value.rlike(INTEGER_FORM) & value.try_cast("bigint").isNotNull()


def is_numeric(value: Column) -> Column:
    return value.rlike(NUMERIC_FORM)


def is_email(value: Column) -> Column:
    return value.rlike(EMAIL_FORM)


def money(value: Column) -> Column:
    """Text or number as DECIMAL(12,2); out-of-range values are NULL."""
    return value.try_cast(MONEY)


def present(value: Column) -> Column:
    """A key counts as given when it is neither null nor the empty text."""
    return value.isNotNull() & (value != "")


def iso8601(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ssxxx")
