"""Structured Streaming ingestion: a landing folder of batch documents per type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from campaignlake.ingest.jobs import run_documents
from campaignlake.settings import DEFAULT_SETTINGS, Settings
from campaignlake.sources.batches import stream_documents
from campaignlake.sources.tables import CampaignStore


def keyed_events_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Event stream without repeated dedup keys, with state bounded by the watermark.

    For readers of the stream itself (`start_keyed_events`); `start_ingest` needs no state, it checks the key index.
    Rows without a key are never repeats of each other, so they pass beside the dedup, late ones too.
    """
    timed = events.withWatermark("occurred_at", delay)
    keyed = timed.where(F.col("dedup_key").isNotNull())
    return keyed.dropDuplicatesWithinWatermark(["version_id", "dedup_key"]).unionByName(
        timed.where(F.col("dedup_key").isNull())
    )


def start_keyed_events(
    events: DataFrame, target: str, checkpoint: str, delay: str = "1 day", available_now: bool = True
) -> StreamingQuery:
    """Append an event stream to the files at `target` without repeated keys, for consumers beside the store.

    The state is one row for each key of the last `delay`, whatever the stream's age; it survives a restart with the
    checkpoint. Keyed rows older than the watermark are dropped: their keys may have been forgotten.
    """
    writer = (
        keyed_events_stream(events, delay).writeStream.format("parquet").outputMode("append")
        .queryName("keyed_events").option("checkpointLocation", checkpoint).option("path", target)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def start_ingest(
    store: CampaignStore,
    batch_type: str,
    landing: str,
    checkpoint: str,
    max_files: int = 1000,
    mode: str = "quarantine",
    settings: Settings = DEFAULT_SETTINGS,
    available_now: bool = True,
) -> StreamingQuery:
    """One query per batch type; each micro-batch is one import.

    The import id is made of the query's checkpointed id and the micro-batch number, so a
    micro-batch that Spark runs again after a failure is found in the ledger and, when it was
    completed, skipped; otherwise it is run again from the tables as they are then.
    """
    documents = stream_documents(store.spark, landing, batch_type, max_files)
    def ingest(batch: DataFrame, number: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        run_documents(store, batch_type, batch, f"{query_id}-{number}", mode, settings)

    writer = (
        documents.writeStream.foreachBatch(ingest)
        .queryName(f"ingest_{batch_type}")
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
