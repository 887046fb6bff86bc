"""Streaming ingestion over a landing folder."""

from __future__ import annotations

import json

from helpers import rows_of, with_players
from pyspark.sql import functions as F

from campaignlake.sources.tables import latest
from campaignlake.sources.tables import CampaignStore
from campaignlake.streaming.ingest_stream import keyed_events_stream, start_ingest, start_keyed_events


def document(path, rows, version_id=1):
    path.write_text(json.dumps({"version_id": version_id, "events": rows}))


def event(player_id, key, **more):
    return {"player_id": player_id, "type": "opened", "occurred_at": "2026-01-01T00:00:00Z", "dedup_key": key, **more}


def drain(store, landing, checkpoint, **options):
    query = start_ingest(store, "events", str(landing), str(checkpoint), **options)
    query.awaitTermination()


def test_micro_batches_are_imports(spark, tmp_path):
    store = CampaignStore(spark, str(tmp_path / "lake"), buckets=2)
    with_players(store, "alice", "bob")
    landing = tmp_path / "landing"
    landing.mkdir()
    document(landing / "1.json", [event(1, "a"), event(1, "a"), event(9, "b"), event(1, None)])
    drain(store, landing, tmp_path / "cp")
    document(landing / "2.json", [event(2, "a"), event(2, "c"), event("x", "d")])
    drain(store, landing, tmp_path / "cp")
    drain(store, landing, tmp_path / "cp")
    assert rows_of(store.read("events"), "player_id", "dedup_key") == [(1, "a"), (1, None), (2, "c")]
    log = latest(store.read("import_log"), "import_id")
    assert rows_of(log, "status", "processed_rows", "inserted", "duplicates", "failed") == [
        ("completed", 2, 1, 1, 0), ("completed", 4, 2, 1, 1),
    ]
    # Import ids carry the id of the checkpointed query, so another query's batch 0 is another import.
    assert len({r.import_id.rsplit("-", 1)[0] for r in log.collect()}) == 1
    assert not log.where("import_id like 'None%'").count()
    # A lost checkpoint replays all files: keyed rows stay single, only key-less rows come again.
    drain(store, landing, tmp_path / "cp2", max_files=1)
    assert store.read("events").groupBy("dedup_key").count().where("dedup_key is not null and count > 1").count() == 0
    assert store.read("events").count() == 4


def test_stream_dedup_within_the_watermark(spark, tmp_path):
    source = tmp_path / "in"
    schema = "version_id long, dedup_key string, occurred_at timestamp"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (1, None), (1, None)], "version_id long, dedup_key string").withColumn(
        "occurred_at", F.lit("2026-01-01").cast("timestamp")
    ).write.parquet(str(source))
    query = (
        keyed_events_stream(spark.readStream.schema(schema).parquet(str(source)))
        .writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert rows_of(spark.table("deduped"), "version_id", "dedup_key") == [(1, "a"), (1, None), (1, None), (2, "a")]


def test_stream_state_is_bounded_by_the_watermark(spark, tmp_path):
    """Each run is a restart of the stream; a run's rows are a day and a half later than those of the run before."""
    schema = "version_id long, dedup_key string, occurred_at timestamp"
    held = []
    for run in range(4):
        rows = spark.range(50).selectExpr(
            "1L as version_id", f"concat('r{run}-', id) as dedup_key", f"timestamp'2026-01-01' + make_dt_interval({run}, {12 * run}, cast(id as int)) as occurred_at"
        )
        rows.union(rows).write.parquet(str(tmp_path / f"in/run={run}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        query = start_keyed_events(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("dedup_key").count().where("count = 1").count() == 200
    assert max(held) <= 100 and held[-1] <= 100
