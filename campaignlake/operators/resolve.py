"""Player resolution: by id inside the version, else by e-mail, else unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlake.operators.keys import match_key, spread_key, touched

IDENTITY = ["version_id", "player_id", "player_email"]


def players_by_email(players: DataFrame, users: DataFrame, wanted: DataFrame) -> DataFrame:
    """(version_id, player_email, email_id) for the wanted (version_id, player_email) pairs."""
    found = touched(users.select(F.col("id").alias("user_id"), F.col("email").alias("player_email")),
                    wanted, ["player_email"])
    return (
        players.select("version_id", F.col("id").alias("email_id"), "user_id")
        .join(found, "user_id")
        .select("version_id", "player_email", "email_id")
    )


def resolve_identities(identities: DataFrame, players: DataFrame, users: DataFrame) -> DataFrame:
    """Add `resolved_id` to rows that hold one identity each."""
    known = touched(
        players.select("version_id", F.col("id").alias("player_id")), identities, ["version_id", "player_id"]
    )
    checked = identities.withColumn("_id", spread_key(F.col("player_id"), F.col("player_email"))).join(
        known.select("version_id", match_key(F.col("player_id")).alias("_id"), F.col("player_id").alias("by_id")),
        ["version_id", "_id"],
        "left",
    )
    fallback = F.when(F.col("by_id").isNull(), F.col("player_email"))
    wanted = checked.select("version_id", fallback.alias("player_email")).where("player_email IS NOT NULL")
    by_email = players_by_email(players, users, wanted).select(
        "version_id", match_key(F.col("player_email")).alias("_mail"), "email_id"
    )
    # Most rows need no e-mail lookup; their unique key keeps them spread.
    row_key = F.concat_ws("/", F.col("player_id").cast("string"), F.col("player_email"))
    return (
        checked.withColumn("_mail", spread_key(fallback, row_key))
        .join(by_email, ["version_id", "_mail"], "left")
        .withColumn("resolved_id", F.coalesce("by_id", "email_id"))
        .drop("_id", "_mail", "by_id", "email_id")
    )


def resolve_players(batch: DataFrame, players: DataFrame, users: DataFrame) -> DataFrame:
    """Add `resolved_id`, NULL when neither lookup succeeds; players are never created here.

    Needs version_id, player_id (bigint) and player_email. Lookups run once per distinct
    identity, so a player who owns a third of the batch is looked up once, and the wide rows
    are joined to the answer a single time.
    """
    identities = batch.select(*IDENTITY).distinct()
    resolved = (
        resolve_identities(identities, players, users)
        .where(F.col("resolved_id").isNotNull())
        .alias("resolved")
    )
    rows = batch.alias("rows")
    same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"resolved.{c}")) for c in IDENTITY]
    return rows.join(resolved, same, "left").select("rows.*", "resolved.resolved_id")


def count_unresolved(batch: DataFrame, players: DataFrame, users: DataFrame) -> DataFrame:
    """`rows` and `failed` of a batch, counted per identity before any lookup."""
    weighted = batch.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n"))
    return resolve_identities(weighted, players, users).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("resolved_id").isNull(), F.col("n"))), F.lit(0)).alias("failed"),
    )
