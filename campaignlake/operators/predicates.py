"""Filter predicates and join conditions."""

from __future__ import annotations

import operator
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlake.settings import DEFAULT_SETTINGS, Settings

COMPARE = {
    "=": operator.eq,
    "!=": operator.ne,
    "<>": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}
DATE_ONLY = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def _literal(value: Any, dtype: T.DataType) -> Column:
    """Value in the column's own type, so the comparison is constant-folded and pushed down."""
    return F.lit(value).try_cast(dtype)


def _text(column: Column, dtype: T.DataType, settings: Settings) -> Column:
    if settings.text_collation and isinstance(dtype, T.StringType):
        return F.collate(column, settings.text_collation)
    return column


def predicate(
    op: str, column: Column, dtype: T.DataType, value: Any, settings: Settings = DEFAULT_SETTINGS
) -> Column:
    """`in`, `eq`, `gte` or `lte` against a literal."""
    column = _text(column, dtype, settings)
    if op == "in":
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        literals = [_literal(v, dtype) for v in values if v is not None]
        return column.isin(*literals) if literals else F.lit(False)
    if op == "eq":
        return column.isNull() if value is None else column == _literal(value, dtype)
    if op == "gte":
        return column >= _literal(value, dtype)
    if op == "lte":
        if settings.inclusive_end_day and DATE_ONLY.match(str(value)):
            next_day = F.lit(value).cast("date") + F.expr("INTERVAL '1' DAY")
            return column < next_day.cast(dtype)
        return column <= _literal(value, dtype)
    raise ValueError(f"Unsupported filter operator: {op}")


def compare_columns(left: Column, op: str, right: Column) -> Column:
    """Column against column, for join conditions and residual predicates."""
    return COMPARE[op](left, right)


def has_prefix(column: Column, prefix: str) -> Column:
    return column.startswith(prefix)
