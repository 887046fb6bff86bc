"""SparkSession with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC keeps zone-less timestamps stable; AQE re-plans joins from real sizes and splits
# skewed join partitions, so no join here carries a broadcast hint.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # Of a key that a payload repeats the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "campaignlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
