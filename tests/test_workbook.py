"""Workbook directories, summary sheets and the export ledger."""

from __future__ import annotations

from datetime import datetime

import pytest
from helpers import seed, with_players

from campaignlake.ingest.ledger import ExportLedger, export_timings
from campaignlake.plans.spec import SpecError
from campaignlake.plans.workbook import MANIFEST, cancel_export, read_sheet, run_export
from campaignlake.sources.tables import CampaignStore


@pytest.fixture
def store(spark, tmp_path):
    store = CampaignStore(spark, str(tmp_path / "lake"), buckets=2)
    with_players(store, "alice", "bob")
    seed(
        store, "events",
        [{"id": i, "version_id": 1, "player_id": 1 + i % 2, "type": "opened", "occurred_at": datetime(2026, 1, i),
          "payload": "[]", "payload_language": "it" if i % 2 else None} for i in range(1, 6)],
    )
    return store


def manifest(spark, store, export_id):
    return spark.read.schema(MANIFEST).json(store.path(f"exports/{export_id}/manifest")).orderBy("sheet_no").collect()


def test_summary_sheets_surround_the_data(spark, store):
    params = {
        "include_summary": True,
        "sheets": [
            {"name": "Events", "source": "events", "columns": ["id", {"field": "language", "as": "id"}]},
            {"name": "Events", "source": "events", "group_by": ["language"], "metrics": ["count"]},
        ],
    }
    export_id = run_export(store, params, 1)
    got = manifest(spark, store, export_id)
    assert [m.name for m in got] == [
        "README", "KPIs", "Configurazione_Richiesta", "Events", "Events (2)", "Data_Quality",
    ]
    path = store.path(f"exports/{export_id}")
    detail = read_sheet(spark, path, 4)
    assert detail.columns == ["id", "id"]
    # NULL cells are empty text, and the parts keep the id order.
    assert [(r[0], r[1] or "") for r in detail.collect()] == [("1", "it"), ("2", ""), ("3", "it"), ("4", ""), ("5", "it")]
    kpis = [tuple(r) for r in read_sheet(spark, path, 2).collect()]
    assert kpis[:3] == [("Events", "5"), ("Events", "2"), ("Total", "7")]
    quality = {r["Check"]: r["Occurrences"] for r in read_sheet(spark, path, 6).collect()}
    assert quality == {"missing_language": "2", "empty_payload": "5", "invalid_event_order": "0"}
    state = ExportLedger(store).state(export_id)
    assert state["status"] == "completed" and state["progress"] == 100 and state["file_size"] > 0
    assert state["total_rows"] == sum(m.rows for m in got)
    assert export_timings(store.read("export_log")).first()["duration_seconds"] >= 0


def test_a_completed_export_is_kept_and_a_rerun_of_a_failed_one_replaces_it(spark, store):
    params = {"format": "parquet", "sheets": [{"source": "events", "columns": ["id"]}]}
    assert run_export(store, params, 1, "e1") == run_export(store, params, 1, "e1") == "e1"
    assert ExportLedger(store).state("e1")["attempts"] == 1
    assert spark.read.parquet(manifest(spark, store, "e1")[0].path).count() == 5


def test_bad_spec_leaves_no_trace(store):
    with pytest.raises(SpecError):
        run_export(store, {"sheets": [{"source": "ghosts"}]}, 1)
    assert store.read("export_log").count() == 0


def test_only_pending_exports_can_be_cancelled(store):
    ExportLedger(store).write("p1", status="pending", version_id=1, params="{}", attempts=0, progress=0)
    assert cancel_export(store, "p1") and not cancel_export(store, "p1")
    run_export(store, {}, 1, "p1")
    assert ExportLedger(store).state("p1")["status"] == "cancelled"
    run_export(store, {}, 1, "e2")
    assert not cancel_export(store, "e2")
