"""Keyed lookups that stay cheap for small batches and even for skewed or missing keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_key(value: Column) -> Column:
    """Text key on the table side of a lookup; NULL stays NULL."""
    return F.concat(F.lit("k:"), value.cast("string"))


def spread_key(value: Column, row_id: Column) -> Column:
    """Key on the batch side: rows without a value get a unique key that matches nothing.

    The prefixes keep the two kinds apart, and the unique part spreads the key-less rows over
    all partitions where NULLs would have met in one.
    """
    return F.coalesce(match_key(value), F.concat(F.lit("r:"), row_id.cast("string")))


def touched(table: DataFrame, batch: DataFrame, on: Sequence[str]) -> DataFrame:
    """Table rows whose key occurs in the batch.

    The batch's distinct keys are the build side: while they fit the broadcast threshold the big
    table is filtered inside its own scan stage, beyond it Spark falls back to a sort-merge join.
    """
    return table.join(batch.select(*on).distinct(), list(on), "left_semi")


def flag_existing(
    df: DataFrame, table: DataFrame, column: str, flag: str, row_id: str, table_key: str = "id"
) -> DataFrame:
    """Add a boolean: does (version_id, `column`) exist in the table? Missing ids are False."""
    left = df.withColumn("_ref", spread_key(F.col(column), F.col(row_id)))
    right = table.select("version_id", match_key(F.col(table_key)).alias("_ref"), F.lit(True).alias(flag))
    joined = left.join(right, ["version_id", "_ref"], "left")
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop("_ref")
