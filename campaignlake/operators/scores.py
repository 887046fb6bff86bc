"""Player score roll-up, its reconciliation, and per-player averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlake.functions.payload import with_payload_columns

GAME_EVENT = "game_completed"


def score_rollup(events: DataFrame, event_type: str = GAME_EVENT) -> DataFrame:
    """Sum of the scores of a player's finished games."""
    return (
        with_payload_columns(events)
        .where(F.col("type") == event_type)
        .groupBy("version_id", "player_id")
        .agg(F.coalesce(F.sum("payload_score"), F.lit(0)).alias("score"))
    )


def player_scores(players: DataFrame, events: DataFrame, event_type: str = GAME_EVENT) -> DataFrame:
    """Every player with the rolled-up score; 0 without finished games."""
    rolled = score_rollup(events, event_type).withColumnRenamed("player_id", "id")
    return players.join(rolled, ["version_id", "id"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0)).cast("bigint")
    )


def refresh_total_scores(players: DataFrame, events: DataFrame, event_type: str = GAME_EVENT) -> DataFrame:
    """Players with `total_score` recomputed from the event log."""
    refreshed = player_scores(players, events, event_type)
    return refreshed.withColumn("total_score", F.col("score")).select(*players.columns)


def score_mismatches(players: DataFrame, events: DataFrame, event_type: str = GAME_EVENT) -> DataFrame:
    """Players whose stored score differs from the event log."""
    return (
        player_scores(players, events, event_type)
        .where(F.col("total_score") != F.col("score"))
        .select("version_id", F.col("id").alias("player_id"), "total_score", "score")
    )


def average_per_player(events: DataFrame) -> DataFrame:
    """Per version: mean of the players' own mean scores, so that busy players weigh no more."""
    own = (
        with_payload_columns(events)
        .groupBy("version_id", "player_id")
        .agg(F.avg(F.col("payload_score").cast("decimal(10,0)")).alias("own"))
    )
    return own.groupBy("version_id").agg(
        F.count("own").alias("players"), F.round(F.avg("own"), 2).cast("double").alias("avg_score")
    )
