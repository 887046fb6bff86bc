"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlake.llm.common import staged


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, v) with v joined to `low`, the smallest of u and its neighbours.

    Both sides are dealt by u already, so a merge join costs no exchange and nothing passes through the driver. A
    hub's edges are streamed, never collected; they are one task's rows of two numbers each."""
    low = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return edges.join(low.hint("merge"), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of `edges` (columns u, v) with the smallest node it is connected to.

    Large star hangs each node's larger neighbours below its smallest one, small star does so with the smaller
    ones; the edge table never grows, and all is done when it is a set of stars: every node below one other,
    which is below none. Every round is staged. Loops and repeated edges are allowed; no edges give no rows.
    """
    at = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(at):
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        small = _lowest(large)
        at = staged(
            small.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(small.select("u", F.col("low").alias("v")))
            .where("u <> v")
            .distinct(),
            "edges",
        )
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """True when no node has two edges to smaller ones, or one to a smaller and one to a larger node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    seen = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return seen.where("below + above > 1").limit(1).count() == 0
