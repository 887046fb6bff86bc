"""Distinct players from mergeable sketches by version, type and day, without reading events again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the sketch's size; 14 has a standard error of about 0.8 % and at most 16 KB, small sets are exact and short.
SIZE = 14


def event_sketches(events: DataFrame) -> DataFrame:
    """One row for each version, type and day of the events."""
    day = F.date_trunc("day", "occurred_at").alias("occurred_at")
    return events.groupBy("version_id", "type", day).agg(
        F.count(F.lit(1)).alias("events"), F.hll_sketch_agg("player_id", SIZE).alias("players")
    )


def unique_players(sketches: DataFrame, by: Sequence[str] = ("version_id",)) -> DataFrame:
    """Events and about how many different players they have, by any of version_id, type and occurred_at (the day).
    Sketches of different batches and days are merged; a player in several of them counts once."""
    return sketches.groupBy(*by).agg(
        F.sum("events").alias("events"), F.hll_sketch_estimate(F.hll_union_agg("players")).alias("unique_players")
    )
