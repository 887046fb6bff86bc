"""Deep pages of the player listing from key ranges with running counts.

Players of a version are kept in ranges of ascending ids, each a directory sorted by id, and counted by pieces of them,
with the number of players before each piece; short pieces make no more directories. A page of any depth opens the one
or two ranges that it lies in, and then the buckets of its own players. Ids only grow, so players that came after the
ranges were built follow them all; they are read from the table until the next build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from campaignlake.functions.normalize import iso8601
from campaignlake.plans.preview import DEFAULT_PAGE, checked_page_size
from campaignlake.sources.tables import CampaignStore, HadoopPath

RANGE_ROWS = 100_000
MIN_RANGE_ROWS = 100_000
RANKED = "id long, user_id long, email string, piece long, range int"
COUNTS = "range int, piece long, first_id long, last_id long, rows long, before long"


def _root(store: CampaignStore, version_id: int) -> str:
    return store.rank_path(version_id)


def _built(store: CampaignStore, version_id: int) -> str | None:
    """The newest complete build of a version's ranges."""
    root = _root(store, version_id)
    found = [n for n in HadoopPath(store.spark, root).names() if HadoopPath(store.spark, f"{root}/{n}/starts/_SUCCESS").exists()]
    return f"{root}/{max(found)}" if found else None


def build_ranks(store: CampaignStore, version_id: int, rows_per_range: int = RANGE_ROWS) -> int:
    """Build a version's ranges from the players of now; returns the number of their pieces of at most
    `rows_per_range` players. The former build serves until the new one is
    complete."""
    with store.lock:
        at, spark = store.snapshot(), store.spark
        emails = store.read("users", at=at).select(F.col("id").alias("user_id"), "email")
        players = store.read("players", [version_id], at).select("id", "user_id").join(emails, "user_id", "left")
        size = store.read("players", [version_id], at).count()
        path = f"{_root(store, version_id)}/{at.last:012d}"
        before = HadoopPath(spark, _root(store, version_id)).names()
        ranges = max(1, -(-size // max(rows_per_range, MIN_RANGE_ROWS)))
        # One sort gives a row its range and its place there; it is written at once and not run again.
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        placed = players.repartitionByRange(ranges, "id").sortWithinPartitions("id").select(
            "id", "user_id", "email", F.floor(place / rows_per_range).alias("piece"), F.spark_partition_id().alias("range")
        )
        placed.write.mode("overwrite").partitionBy("range").parquet(f"{path}/ids")
        counts = spark.read.schema(RANKED).parquet(f"{path}/ids").groupBy("range", "piece").agg(
            F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("rows")
        )
        # The ranges are few; pieces are numbered inside theirs.
        earlier = lambda window: F.coalesce(F.sum("rows").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.groupBy("range").agg(F.sum("rows").alias("rows")).select("range", earlier(Window.orderBy("range")).alias("start"))
        inside = counts.withColumn("before", earlier(Window.partitionBy("range").orderBy("piece")))
        counts = inside.join(starts, "range").withColumn("before", F.col("before") + F.col("start")).drop("start")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/starts")
        for name in before:
            if name != path.rsplit("/", 1)[1]:
                HadoopPath(spark, f"{_root(store, version_id)}/{name}").delete()
        return spark.read.schema(COUNTS).parquet(f"{path}/starts").count()


def page_ids(store: CampaignStore, version_id: int, page: int = 1, per_page: int = DEFAULT_PAGE) -> DataFrame:
    """(id, user_id, email) of a page, from the ranges it lies in and, past them, from younger players."""
    size, spark = checked_page_size(per_page), store.spark
    offset = (max(page, 1) - 1) * size
    built = _built(store, version_id)
    counts = spark.read.schema(COUNTS).parquet(f"{built}/starts") if built else spark.createDataFrame([], COUNTS)
    whole = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max("last_id").alias("last_id")).first()
    hit = counts.where((F.col("before") < offset + size) & (F.col("before") + F.col("rows") > offset)).orderBy("before").collect()
    found = spark.createDataFrame([], "id long, user_id long, email string")
    if hit:
        rows = spark.read.schema(RANKED).parquet(f"{built}/ids").where(F.col("range").isin(*{r["range"] for r in hit}))
        rows = rows.where(F.col("id").between(hit[0]["first_id"], hit[-1]["last_id"]))
        found = rows.orderBy("id").offset(offset - hit[0]["before"]).limit(size).select("id", "user_id", "email")
    if offset + size > whole["rows"]:
        at = store.snapshot()
        young = store.read("players", [version_id], at)
        if whole["last_id"] is not None:
            young = young.where(F.col("id") > whole["last_id"])
        skipped = max(0, offset - whole["rows"])
        young = young.orderBy("id").offset(skipped).limit(size - max(0, whole["rows"] - offset)).select("id", "user_id")
        emails = store.read("users", at=at).select(F.col("id").alias("user_id"), "email")
        found = found.unionByName(young.join(emails, "user_id", "left").select("id", "user_id", "email"))
    return found


def ranked_page(store: CampaignStore, version_id: int, page: int = 1, per_page: int = DEFAULT_PAGE) -> DataFrame:
    """A page of the listing in order of id, whatever its depth."""
    # A page has few rows: they are looked up as they are, and the ranges are not read again for each use.
    ids = store.spark.createDataFrame(page_ids(store, version_id, page, per_page).collect(), "id long, user_id long, email string")
    keys = ids.select(F.lit(version_id).cast("long").alias("version_id"), "user_id")
    players = store.matching("players", keys, [version_id]).select("id", "registered_at", "total_score", "language")
    return ids.join(players, "id").select("id", "email", iso8601(F.col("registered_at")).alias("registered_at"), "total_score", "language").orderBy("id")
