"""Two-pass external shuffle into shards, with built-in functions only.

Pass 1 scatters whole rows into buckets by a seeded hash of the row, with so many buckets that one holds about
BUCKET_ROWS rows and BUCKET_BYTES bytes. Pass 2 permutes the row numbers of each bucket by a seeded Fisher-Yates
shuffle (the built-in `shuffle`) and puts the buckets one after the other. A row's place in that sequence is a random
permutation of all rows; it is dealt out so that shard sizes differ by one row at most. A bucket's rows thus come to
lie one after the other in every shard, so the task that holds a bucket writes its part of all shards: the rows cross
the network once.

Defined cases: rows with one key, or without one, are scattered by their other columns; rows equal in all columns
share a bucket and are interchangeable; an empty table gives an empty result; input columns that bear the name of a
result column (`shard`, `slot`) are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campaignlake.llm.common import staged

BUCKET_ROWS = 4096
BUCKET_BYTES = 64 << 20
#: Buckets whose offsets are summed up in one group; the groups' totals are summed up after that.
OFFSET_GROUP = 1024


def _scattered(rows: DataFrame, key: str, seed: int, bucket_rows: int) -> DataFrame:
    """`rows` as a struct `_row`, with `_bucket` and the order within it."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    size = sum((F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) for n, t in rows.dtypes if t in ("string", "binary")), F.lit(8))
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    n_buckets = max(1, -(-total["rows"] // bucket_rows), -(-total["bytes"] // BUCKET_BYTES))
    return rows.select(
        F.struct(*columns).alias("_row"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), *columns), F.lit(n_buckets)).cast("int").alias("_bucket"),
        F.xxhash64(F.lit(seed + 1), F.col(f"`{key}`"), *columns).alias("_order"),
    )


def _moves(scattered: DataFrame, seed: int) -> DataFrame:
    """For each bucket its offset and the permutation of its row numbers, an array of integers."""
    sizes = scattered.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size")).withColumn("_group", F.expr(f"_bucket div {OFFSET_GROUP}"))
    earlier = lambda w: F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = staged(sizes, "bucket-sizes")
    groups = sizes.groupBy("_group").agg(F.sum("_size").alias("_size")).select("_group", earlier(Window.orderBy("_group")).alias("_before"))
    placed = sizes.withColumn("_inside", earlier(Window.partitionBy("_group").orderBy("_bucket"))).join(groups, "_group")
    return placed.select(
        "_bucket",
        (F.col("_before") + F.col("_inside")).alias("_offset"),
        F.shuffle(F.sequence(F.lit(0), F.col("_size").cast("int") - 1), seed).alias("_to"),
    )


def shuffled_shards(rows: DataFrame, key: str, n_shards: int, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`rows` with `shard` (0..n_shards-1) and `slot` (0.. without gaps in each shard).

    The permutations are staged, since the generator's state depends on the task that draws them: a task that runs
    again reads the ones drawn first. They are joined by bucket alone, the key that the rows are scattered by.
    """
    scattered = _scattered(rows.drop("shard", "slot"), key, seed, bucket_rows)
    moves = staged(_moves(scattered, seed), "permutations")
    numbered = scattered.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy("_order", "_row")))
    place = F.expr("_offset + _to[_at - 1]")
    return numbered.join(moves.hint("merge"), "_bucket").select(
        "_row.*",
        F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"),
        F.expr(f"(_offset + _to[_at - 1]) div {n_shards}").cast("long").alias("slot"),
    )


def write_shards(rows: DataFrame, key: str, n_shards: int, path: str, seed: int = 17) -> None:
    """Writes `rows` under `path` as `shard=<n>/` folders; each file is in slot order and holds the slots of the
    buckets that its task had."""
    dealt = shuffled_shards(rows, key, n_shards, seed)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
