"""Payload keys declared by path: cases, guards, plans and the layout of a store that keeps variants."""

from __future__ import annotations

import pytest

from campaignlake.ingest.jobs import run_import
from campaignlake.plans.guards import check_spec
from campaignlake.plans.sheet import compile_sheet
from campaignlake.plans.spec import SpecError, parse_spec
from campaignlake.sources.registry import DEFAULT_REGISTRY
from campaignlake.sources.tables import CampaignStore
from helpers import batch, frame, with_players

REGISTRY = DEFAULT_REGISTRY.with_path("events", "os", "$.device.os").with_path("events", "build", "$.device.build", "int", sort=True)
ROWS = [
    '{"device": {"os": "ios", "build": 3}}', '{"device": {"os": 5, "build": "7"}}', '{"device": {"os": null}}', '{"device": "old"}',
    "no json", "[]", None, '{"device": {"os": "a", "os": "b", "build": 99999999999}}', '{"device": {"os": {"x": 1.50}}}',
]
WANT = [("ios", 3), ("5", 7), (None, None), (None, None), (None, None), (None, None), (None, None), ("b", None), ('{"x":1.5}', None)]


def sheet_of(tables, version_id, **asked):
    params = {"sheets": [{"name": "d", "source": "events", **asked}]}
    check_spec(params, registry=REGISTRY)
    return compile_sheet(parse_spec(params, "2024-01-31", REGISTRY).sheets[0], tables, version_id, REGISTRY)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def events(spark):
    return frame(spark, "events", [{"id": i, "version_id": 1, "type": "t", "payload": p} for i, p in enumerate(ROWS)])


def test_values_of_paths(spark):
    got = sheet_of({"events": events(spark)}, 1, columns=["id", "payload.os", "build"]).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == WANT
    assert sheet_of({"events": events(spark).where("false")}, 1, columns=["os"]).collect() == []


def test_paths_filter_sort_and_group(spark):
    tables = {"events": events(spark)}
    got = sheet_of(tables, 1, columns=["os"], filters={"os": ["ios", "b"]}, sort=["build:desc"]).collect()
    assert [r[0] for r in got] == ["ios", "b"]
    grouped = sheet_of(tables, 1, columns=["os", {"fn": "sum", "field": "build", "as": "s"}], group_by=["payload.os"])
    assert {r.os: r.s for r in grouped.collect()} == {"ios": 3, "5": 7, None: None, "b": None, '{"x":1.5}': None}


def test_only_declared_paths_are_allowed():
    for asked in ({"columns": ["payload.device"]}, {"group_by": ["tags"]}, {"columns": [{"fn": "sum", "field": "os"}]}, {"sort": ["os"]}):
        with pytest.raises(SpecError):
            check_spec({"sheets": [{"name": "events", **asked}]}, registry=REGISTRY)
    with pytest.raises(ValueError):
        REGISTRY.with_path("events", "language", "$.lang")
    with pytest.raises(SpecError):
        check_spec({"sheets": [{"name": "events", "columns": ["os"]}]})


def test_text_is_parsed_once_for_all_paths(spark):
    plan = plan_of(sheet_of({"events": events(spark)}, 1, columns=["os", "build"]))
    assert plan.count("parseJson") == 1


def test_store_reads_the_paths_and_no_text(spark, tmp_path):
    store = CampaignStore(spark, str(tmp_path / "lake"), buckets=2, variants=True)
    with_players(store, "ann")
    assert store.read("events").collect() == []
    rows = [{"player_id": 1, "type": "t", "occurred_at": "2024-01-05T10:00:00Z", "payload": p} for p in ROWS if p != "no json"]
    run_import(store, "events", batch(spark, "events", rows), "A")
    sheet = sheet_of(store.tables([1]), 1, columns=["id", "os", "build"])
    assert [tuple(r)[1:] for r in sorted(sheet.collect())] == WANT[:4] + WANT[5:]
    plan = plan_of(sheet)
    scanned = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert "parseJson" not in plan and scanned and "payload:string" not in plan
    assert "payload_variant:struct<0:string,1:int>" in scanned[0] or "payload_variant:struct<0:int,1:string>" in scanned[0], scanned
    store.compact_log("events", [1], "2024-01-01", "2024-02-01")
    assert sorted(map(tuple, sheet_of(store.tables([1]), 1, columns=["os", "build"]).collect()), key=str) == sorted(WANT[:4] + WANT[5:], key=str)


def test_layout_says_whether_variants_are_kept(spark, tmp_path):
    kept, plain = (CampaignStore(spark, str(tmp_path / n), buckets=2, variants=v) for n, v in (("kept", True), ("plain", None)))
    for store in (kept, plain):
        with_players(store, "ann")
    assert CampaignStore(spark, kept.root).variants and not CampaignStore(spark, plain.root).variants
    for store, other in ((kept, False), (plain, True)):
        with pytest.raises(ValueError):
            CampaignStore(spark, store.root, variants=other)
    rows = [{"player_id": 1, "type": "t", "occurred_at": "2024-01-05T10:00:00Z", "payload": p} for p in ROWS[:2]]
    run_import(plain, "events", batch(spark, "events", rows), "A")
    got = sheet_of(plain.tables([1]), 1, columns=["os", "build"]).collect()
    assert [tuple(r) for r in sorted(got)] == sorted(WANT[:2])
