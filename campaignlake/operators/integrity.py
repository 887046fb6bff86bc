"""Referential checks that a database would enforce with foreign keys."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlake.schemas import RELATIONS


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    ids = parent.select(F.col(parent_key).alias(column))
    return child.where(F.col(column).isNotNull()).join(ids, column, "left_anti")


def orphan_counts(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """version_id, missing reference and its number of child rows.

    References are counted before the anti-join, so one row per distinct id is shuffled and a
    reference used by a third of the rows costs no more than any other.
    """
    used = (
        child.where(F.col(column).isNotNull())
        .groupBy("version_id", column)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return orphans(used, column, parent, parent_key)


def version_mismatches(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Number of child rows per pair of differing child and parent versions."""
    used = (
        child.where(F.col(column).isNotNull())
        .groupBy("version_id", column)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    owner = parent.select(F.col("id").alias(column), F.col("version_id").alias("parent_version_id"))
    return (
        used.join(owner, column)
        .where(F.col("version_id") != F.col("parent_version_id"))
        .groupBy("version_id", "parent_version_id")
        .agg(F.sum("rows").alias("rows"))
    )


def integrity_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """child, column, parent and number of orphan rows, for every known relation of the tables.

    A child is scanned once for all its references, which are counted before they are looked up,
    and a parent's ids are read once for all children.
    """
    needed = {name for (child, _), parent in RELATIONS.items() for name in (child, parent)}
    opened = {name: tables[name] for name in needed if name in tables}
    known = {
        (child, column): parent
        for (child, column), parent in RELATIONS.items()
        if parent in opened and child in opened and column in opened[child].columns
    }
    relation = lambda child, column: F.lit(f"{child}.{column}")
    used = []
    for child in sorted({child for child, _ in known}):
        held = [
            F.struct(relation(child, column).alias("relation"), F.lit(known[child, column]).alias("parent"), F.col(column).cast("bigint").alias("ref"))
            for owner, column in known
            if owner == child
        ]
        used.append(opened[child].select(F.inline(F.array(*held))).where("ref is not null"))
    refs = reduce(DataFrame.unionByName, used).groupBy("relation", "parent", "ref").agg(F.count(F.lit(1)).alias("rows"))
    ids = [opened[p].select(F.lit(p).alias("parent"), F.col("id").cast("bigint").alias("ref")) for p in sorted(set(known.values()))]
    missing = refs.join(reduce(DataFrame.unionByName, ids), ["parent", "ref"], "left_anti")
    lost = missing.groupBy("relation").agg(F.sum("rows").alias("orphans"))
    spark = next(iter(opened.values())).sparkSession
    every = spark.createDataFrame(
        [(f"{child}.{column}", child, column, parent) for (child, column), parent in known.items()],
        "relation string, child string, column string, parent string",
    )
    return every.join(lost, "relation", "left").select(
        "child", "column", "parent", F.coalesce("orphans", F.lit(0)).cast("bigint").alias("orphans")
    )
