"""Keyed upserts of users and players, as frames of the rows to rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlake.operators.dedup import last_wins
from campaignlake.operators.keys import touched


def collapse_users(batch: DataFrame) -> DataFrame:
    """Last row per e-mail (whole batch, all versions share the users table)."""
    return last_wins(batch.select("email", "external_id", "ord"), ["email"])


def collapse_players(batch: DataFrame, chunk_size: int | None = None) -> DataFrame:
    """Last row per (version_id, e-mail), plus the number of chunks the e-mail occurs in.

    Chunks only matter for the counters: a repeat inside one chunk counts nowhere, a repeat in a
    later chunk counts as a duplicate.
    """
    chunk = F.lit(0) if chunk_size is None else F.floor(F.col("ord") / chunk_size)
    keys = ["version_id", "email"]
    # Distinct first: the partial aggregate ships each (key, chunk) once, however often repeated.
    chunks = (
        batch.select(*keys, chunk.alias("_chunk")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"))
    )
    last = last_wins(batch.select(*keys, "registered_at", "language", "ord"), keys)
    return last.join(chunks, keys)


def merge_users(existing: DataFrame, batch: DataFrame, first_id: int, now: Column) -> DataFrame:
    """Existing users with external_id replaced, and the new ones.

    One full outer join: each side, which may be a long plan, is computed once. Imports hand over the existing rows of
    their keys only.
    """
    fresh = batch.select("email", F.col("external_id").alias("_external"), "ord")
    hit, new = F.col("ord").isNotNull(), F.col("id").isNull()
    return existing.join(fresh, "email", "full").select(
        F.coalesce("id", (F.lit(first_id) + F.col("ord")).cast("bigint")).alias("id"),
        "email",
        F.when(hit, F.col("_external")).otherwise(F.col("external_id")).alias("external_id"),
        F.when(new, now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def merge_players(existing: DataFrame, batch: DataFrame, first_id: int, now: Column) -> DataFrame:
    """Existing players with registered_at and language replaced, and the new ones, by one full outer join.

    total_score is never touched; new players start at 0. `touched_chunks` and `is_new` carry
    what the counters need.
    """
    keys = ["version_id", "user_id"]
    fresh = batch.select(
        *keys,
        F.col("registered_at").alias("_registered"),
        F.col("language").alias("_language"),
        F.col("chunks").alias("_chunks"),
        "ord",
    )
    hit, new = F.col("_chunks").isNotNull(), F.col("id").isNull()
    return existing.join(fresh, keys, "full").select(
        F.coalesce("id", (F.lit(first_id) + F.col("ord")).cast("bigint")).alias("id"),
        *keys,
        F.when(hit, F.col("_registered")).otherwise(F.col("registered_at")).alias("registered_at"),
        F.when(new, F.lit(0).cast("bigint")).otherwise(F.col("total_score")).alias("total_score"),
        F.when(hit, F.col("_language")).otherwise(F.col("language")).alias("language"),
        F.when(new, now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce("_chunks", F.lit(0)).cast("bigint").alias("touched_chunks"),
        new.alias("is_new"),
    )


def player_counters(merged: DataFrame) -> DataFrame:
    """inserted = new players; duplicates = every further chunk that touched one."""
    inserted = F.count_if("is_new")
    return merged.agg(
        inserted.alias("inserted"),
        (F.coalesce(F.sum("touched_chunks"), F.lit(0)) - inserted).alias("duplicates"),
    )


def external_id_clashes(batch: DataFrame, users: DataFrame) -> DataFrame:
    """E-mails whose external_id belongs to another e-mail, stored or earlier in the batch."""
    given = batch.where(F.col("external_id").isNotNull()).select("external_id", "email", "ord")
    owners = (
        given.groupBy("external_id").agg(F.min_by("email", "ord").alias("owner")).select("external_id", "owner")
    )
    stored = touched(
        users.where(F.col("external_id").isNotNull()).select("external_id", F.col("email").alias("stored")),
        given,
        ["external_id"],
    )
    owner = (
        owners.join(stored, "external_id", "left")
        .select("external_id", F.coalesce("stored", "owner").alias("owner"))
    )
    pairs = given.select("external_id", "email").distinct()
    return pairs.join(owner, "external_id").where(F.col("email") != F.col("owner")).select("email").distinct()
