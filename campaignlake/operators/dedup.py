"""First-wins and last-wins collapse, and removal of rows already stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlake.operators.keys import match_key, spread_key, touched


def _first_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    # `row_number() = 1` makes Spark put a WindowGroupLimit before the shuffle: every map task
    # keeps one row per key, so a key repeated in a third of the rows ships one row per task.
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def first_wins(df: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    return _first_by(df, keys, F.col(order).asc())


def last_wins(df: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """The last row replaces the whole record, NULL fields included."""
    return _first_by(df, keys, F.col(order).desc())


def new_rows(
    batch: DataFrame, existing: DataFrame, wanted: DataFrame | None = None, order: str = "ord"
) -> DataFrame:
    """Rows to append: keyed rows once per (version_id, dedup_key) and only when not stored yet.

    Rows without a dedup key always pass. One shuffle serves both steps: the collapse and the
    anti-join are clustered by the same two columns. `wanted` is any frame that holds at least
    the batch's version_id and dedup_key, e.g. the raw rows before they were joined.
    """
    keys = ["version_id", "_key"]
    stored, asked = (
        df.where(F.col("dedup_key").isNotNull()).select(
            "version_id", match_key(F.col("dedup_key")).alias("_key")
        )
        for df in (existing, batch if wanted is None else wanted)
    )
    keyed = batch.withColumn("_key", spread_key(F.col("dedup_key"), F.col(order)))
    return first_wins(keyed, keys, order).join(touched(stored, asked, keys), keys, "left_anti").drop("_key")


def new_by_natural_key(
    batch: DataFrame, existing: DataFrame, keys: Sequence[str], order: str = "ord"
) -> DataFrame:
    """First row per natural key, when that key is not stored yet."""
    probe = touched(existing.select(*keys), batch, keys)
    return first_wins(batch, keys, order).join(probe, list(keys), "left_anti")
