"""The closed list of sheet aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlake.settings import DEFAULT_SETTINGS, Settings


def average(column: Column, dtype: T.DataType) -> Column:
    """Exact decimal average rounded half-up to cents, as a double."""
    exact = {
        T.ByteType: "decimal(10,0)",
        T.ShortType: "decimal(10,0)",
        T.IntegerType: "decimal(10,0)",
        T.LongType: "decimal(20,0)",
    }.get(type(dtype))
    value = column.cast(exact) if exact else column
    return F.round(F.avg(value), 2).cast("double")


def total(column: Column, dtype: T.DataType, settings: Settings = DEFAULT_SETTINGS) -> Column:
    summed = F.sum(column)
    if settings.compat_int_sum or isinstance(dtype, T.IntegralType):
        return summed.cast("bigint")
    return summed


def aggregate(
    fn: str, column: Column | None, dtype: T.DataType | None, settings: Settings = DEFAULT_SETTINGS
) -> Column:
    if fn == "count":
        return F.count(F.lit(1))
    if fn == "count_distinct":
        return F.approx_count_distinct(column, settings.approx_distinct) if settings.approx_distinct else F.count_distinct(column)
    if fn == "avg":
        return average(column, dtype)
    if fn == "sum":
        return total(column, dtype, settings)
    if fn == "min":
        return F.min(column)
    if fn == "max":
        return F.max(column)
    raise ValueError(f"Unsupported aggregate: {fn}")
