"""Sheets over payload keys that no table stores as a column, from text and from a store that keeps variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlake.ingest.jobs import replay, run_import
from campaignlake.plans.guards import check_spec
from campaignlake.plans.sheet import compile_sheet
from campaignlake.plans.spec import parse_spec
from campaignlake.sources.registry import DEFAULT_REGISTRY
from suite import standins as st
from suite.sheets import Query
from suite.stored import event_rows, seeded_store, work_folder

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

REGISTRY = (
    DEFAULT_REGISTRY.with_path("events", "os", "$.device.os")
    .with_path("events", "build", "$.device.build", "int", sort=True)
    .with_path("events", "first_tag", "$.tags[0]")
)

# Every 11th payload is no JSON, every 13th has no device, every 17th a build that is no number; {0} is the event's number.
PAYLOAD = (
    "case when {0} % 11 = 0 then 'broken {{' when {0} % 13 = 0 then '{{\"tags\": []}}' else "
    "'{{\"device\": {{\"os\": \"' || case {0} % 4 when 0 then 'ios' when 1 then 'web' else 'android' end || '\", \"build\": ' || "
    "case when {0} % 17 = 0 then '\"beta\"' else cast({0} % 40 as string) end || '}}, \"tags\": [\"t' || cast({0} % 3 as string) || '\", \"x\"]}}' end"
)
HELD = "event_id % 11 <> 0 and event_id % 13 <> 0"
OS = f"case when {HELD} then case event_id % 4 when 0 then 'ios' when 1 then 'web' else 'android' end end"
BUILD = f"case when {HELD} and event_id % 17 <> 0 then event_id % 40 end"
TAG = f"case when {HELD} then 't' || cast(event_id % 3 as string) end"

GROUPED = {
    "name": "devices", "source": "events", "group_by": ["payload.os", "payload.first_tag"],
    "columns": ["payload.os", "payload.first_tag", {"fn": "count", "as": "n"}, {"fn": "sum", "field": "build", "as": "builds"},
                {"fn": "max", "field": "build", "as": "newest"}, {"fn": "count_distinct", "field": "build", "as": "kinds"}],
}
FILTERED = {
    "name": "phones", "source": "events", "columns": ["id", "os", "build", "first_tag"], "filters": {"os": ["ios", "android"], "build": 7},
    "sort": ["build:desc"],
}


def _sheet(tables, asked: dict) -> DataFrame:
    params = {"sheets": [asked]}
    check_spec(params, registry=REGISTRY)
    return compile_sheet(parse_spec(params, "2024-01-31", REGISTRY).sheets[0], tables, None, REGISTRY)


def text_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"events": st.table(spark, sf_dir, "events").withColumn("payload", F.expr(PAYLOAD.format("id")))}


QUERIES["payload_paths_grouped"] = lambda spark, sf: _sheet(text_tables(spark, sf), GROUPED)
ORACLES["payload_paths_grouped"] = (
    f"select user_id % 3 as version_id, {OS} as os, {TAG} as first_tag, count(*) as n, cast(sum({BUILD}) as bigint) as builds, "
    f"cast(max({BUILD}) as int) as newest, count(distinct {BUILD}) as kinds from events group by 1, 2, 3"
)
QUERIES["payload_paths_filtered"] = lambda spark, sf: _sheet(text_tables(spark, sf), FILTERED)
ORACLES["payload_paths_filtered"] = (
    f"select user_id % 3 as version_id, event_id as id, {OS} as os, cast({BUILD} as int) as build, {TAG} as first_tag from events "
    f"where {OS} in ('ios', 'android') and {BUILD} = 7"
)


def variant_store(spark: SparkSession, sf_dir: str):
    """Two imports of events into a store that keeps variants; the days of the first are rewritten and the second replayed."""
    store = seeded_store(spark, sf_dir, work_folder(spark), variants=True)
    # An import takes no text that is not JSON.
    stored = PAYLOAD.format("ord").replace("'broken {'", "'[1]'")
    for name, where in (("A", "event_id % 2 = 0"), ("B", "event_id % 2 = 1")):
        run_import(store, "events", event_rows(spark, sf_dir, where, "'tap'").withColumn("payload", F.expr(stored)), name)
        if name == "A":
            store.compact_log("events", [0, 1, 2], "2024-01-01", "2024-01-20")
    runs = store.read("import_log").where("status = 'completed'")
    replay(store, runs.where("batch_id = 'B'").first()["import_id"])
    return store


def payload_paths_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouped sheet from stored variants; the seed's events have empty payloads."""
    return _sheet(variant_store(spark, sf_dir).tables([0, 1, 2]), GROUPED)


QUERIES["payload_paths_stored"] = payload_paths_stored
ORACLES["payload_paths_stored"] = (
    f"with every as (select user_id, {OS} as os, {BUILD} as build, {TAG} as tag from events "
    "union all select user_id, null, null, null from events where event_type = 'view') "
    "select user_id % 3 as version_id, os, tag as first_tag, count(*) as n, cast(sum(build) as bigint) as builds, "
    "cast(max(build) as int) as newest, count(distinct build) as kinds from every group by 1, 2, 3"
)
