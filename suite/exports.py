"""Queries over exports and version jobs: summary sheets, read-back order, ledgers, wiped versions, stored payloads."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campaignlake.functions.payload import with_stored_payload
from campaignlake.ingest.jobs import run_import
from campaignlake.ingest.ledger import create_version, export_timings
from campaignlake.plans.workbook import cancel_export, export_workbook, read_sheet, run_export
from campaignlake.ingest.ledger import ExportLedger
from suite import standins as st
from suite.sheets import Query
from suite.standins import ctes
from suite.stored import event_rows, failing, seeded_store, work_folder

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SUMMARY_REQUEST = {
    "include_summary": True,
    "date_from": "1990-01-01",
    "sheets": [
        {"name": "By/type", "source": "events", "group_by": ["type"], "metrics": ["count"]},
        {"name": "By:type", "source": "events", "columns": ["id", {"field": "type", "as": "kind"}], "filters": {"type": ["click", "view"]}, "sort": ["id:desc"]},
        {"name": "Player ids \u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9", "source": "players", "columns": ["player_id"]},
    ],
}


def workbook_summary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the README, KPI and configuration sheets of an export, with the names of all its sheets."""
    path = f"{work_folder(spark)}/export"
    written = export_workbook(spark, SUMMARY_REQUEST, st.tables(spark, sf_dir), 2, path, "e-1", now=datetime(2026, 5, 4, 3, 2, 1))
    cells = [
        read_sheet(spark, path, w.number).toDF("label", "value").select(F.lit(w.name).alias("sheet"), "label", "value")
        for w in written if w.name in ("README", "KPIs", "Configurazione_Richiesta")
    ]
    names = spark.createDataFrame([("names", str(w.number), w.name) for w in written], "sheet string, label string, value string")
    return reduce(DataFrame.unionByName, [*cells, names])


LONG_NAME = SUMMARY_REQUEST["sheets"][2]["name"]
QUERIES["workbook_summary_cells"] = workbook_summary_cells
ORACLES["workbook_summary_cells"] = (
    ctes("events", "players")
    + ", n as (select (select count(distinct type) from s_events where version_id = 2 and occurred_at >= timestamp '1990-01-01') as a, "
    "(select count(*) from s_events where version_id = 2 and type in ('click', 'view') and occurred_at >= timestamp '1990-01-01') as b, "
    "(select count(*) from s_players where version_id = 2) as c) "
    "select 'KPIs' as sheet, 'By/type' as label, cast(a as string) as value from n union all select 'KPIs', 'By:type', cast(b as string) from n "
    f"union all select 'KPIs', '{LONG_NAME}', cast(c as string) from n union all select 'KPIs', 'Total', cast(a + b + c as string) from n "
    "union all select * from (values ('KPIs', 'Format', 'xlsx'), ('KPIs', 'Generated at', '2026-05-04T03:02:01'), "
    "('README', 'Export ID', 'e-1'), ('README', 'Version ID', '2'), ('README', 'Generated at', '2026-05-04T03:02:01'), ('README', 'Format', 'xlsx'), "
    f"('README', 'Sheets included', 'By/type, By:type, {LONG_NAME}'), "
    "('Configurazione_Richiesta', 'include_summary', '1'), ('Configurazione_Richiesta', 'date_from', '1990-01-01'), "
    "('Configurazione_Richiesta', 'Sheet 1 (By/type) - source', 'events'), ('Configurazione_Richiesta', 'Sheet 1 (By/type) - group_by', 'type'), "
    "('Configurazione_Richiesta', 'Sheet 1 (By/type) - metrics', 'count'), ('Configurazione_Richiesta', 'Sheet 2 (By:type) - source', 'events'), "
    "('Configurazione_Richiesta', 'Sheet 2 (By:type) - columns', 'id, {\"field\":\"type\",\"as\":\"kind\"}'), "
    "('Configurazione_Richiesta', 'Sheet 2 (By:type) - sort', 'id:desc'), ('Configurazione_Richiesta', 'Sheet 2 (By:type) - filters', 'type: [\"click\",\"view\"]'), "
    f"('Configurazione_Richiesta', 'Sheet 3 ({LONG_NAME}) - source', 'players'), ('Configurazione_Richiesta', 'Sheet 3 ({LONG_NAME}) - columns', 'player_id'), "
    "('names', '1', 'README'), ('names', '2', 'KPIs'), ('names', '3', 'Configurazione_Richiesta'), ('names', '4', 'By type'), ('names', '5', 'By type (2)'), "
    f"('names', '6', '{LONG_NAME[:21].strip()}'), ('names', '7', 'Data_Quality'))"
)

ORDERED = {"sheets": [{"name": "ordered", "source": "transactions", "columns": ["id", "type", "amount"], "sort": ["amount:desc", "id"]}]}


def sheet_read_back_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorted sheet as its files hold it: every row with its place in the sheet."""
    path = f"{work_folder(spark)}/export"
    export_workbook(spark, ORDERED, st.tables(spark, sf_dir), 1, path)
    written = spark.read.json(f"{path}/manifest").first()
    rows = spark.read.schema("id string, kind string, amount string").csv(written["path"]).select(
        "*", F.regexp_extract(F.col("_metadata.file_path"), r"part-(\d+)", 1).cast("int").alias("part"), F.monotonically_increasing_id().alias("line")
    )
    # Within a file rows are numbered as they stand; part files follow each other by name.
    place = F.row_number().over(Window.orderBy("part", "line"))
    return rows.select(place.alias("place"), "id", "kind")


QUERIES["sheet_read_back_order"] = sheet_read_back_order
ORACLES["sheet_read_back_order"] = (
    ctes("transactions")
    + "select cast(row_number() over (order by amount desc, id) as int) as place, cast(id as string) as id, type as kind from s_transactions where version_id = 1"
)


def export_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest state of exports of all outcomes: completed, repeated, failed and tried again, cancelled."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    request = {"format": "json", "sheets": [{"name": "e", "source": "events", "columns": ["id"]}, {"name": "n", "source": "events", "group_by": ["type"], "metrics": ["count"]}]}
    run_export(store, request, 1, "done")
    run_export(store, request, 1, "done")
    ExportLedger(store).write("waiting", status="pending", version_id=1, params="{}", attempts=0, progress=0)
    cancel_export(store, "waiting")
    cancel_export(store, "done")
    lost = type(store).tables
    type(store).tables = lambda self, versions=None: {}
    try:
        failing(lambda: run_export(store, request, 2, "again"))
        failing(lambda: run_export(store, request, 2, "never"))
    finally:
        type(store).tables = lost
    run_export(store, request, 2, "again")
    timed = (F.col("duration_seconds") >= 0) & (F.col("queue_seconds") >= 0)
    return export_timings(store.read("export_log")).select(
        "export_id", "version_id", "format", "status", "attempts", "progress", "total_rows", timed.alias("timed"), (F.col("file_size") > 0).alias("has_files")
    )


QUERIES["export_ledger"] = export_ledger
ORACLES["export_ledger"] = (
    "with n as (select user_id % 3 as v, count(*) + count(distinct event_type) as n from events where event_type = 'view' group by 1) "
    "select 'done' as export_id, 1 as version_id, 'json' as format, 'completed' as status, 1 as attempts, 100 as progress, n as total_rows, true as timed, true as has_files from n where v = 1 "
    "union all select 'again', 2, 'json', 'completed', 2, 100, n, true, true from n where v = 2 "
    "union all select 'never', 2, 'json', 'failed', 1, null, null, true, null "
    "union all select 'waiting', 1, null, 'cancelled', 0, 0, null, null, null"
)


def version_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version is created, two are filled, one is wiped with the users of a prefix: rows that are left by version."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    created = create_version(store, {"name": "new"})
    run_import(store, "events", event_rows(spark, sf_dir, "event_id % 2 = 0", "'game_completed'").withColumn("payload", F.lit('{"score": 1}')), "x")
    fresh = st.load(spark, sf_dir, "customer").selectExpr(
        "'tmp-' || cast(c_custkey as string) || '@example.com' as email", "cast(null as string) as external_id", "cast(null as string) as registered_at",
        "'it' as language", f"case when c_custkey % 2 = 0 then 0 else {created} end as version_id", "c_custkey as ord",
    )
    run_import(store, "players", fresh, "p")
    store.wipe_version(0, email_prefix="tmp-")
    parts = [store.read(t).groupBy("version_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("stored"), "version_id", "n") for t in ("events", "players", "event_sketches")]
    users = store.read("users").agg(F.count(F.lit(1)).alias("n")).select(F.lit("users").alias("stored"), F.lit(None).cast("long").alias("version_id"), "n")
    versions = store.read("versions").where(F.col("id") == created).groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("status").alias("stored"), F.lit(created).cast("long").alias("version_id"), "n"
    )
    return reduce(DataFrame.unionByName, [*parts, users, versions])


QUERIES["version_jobs"] = version_jobs
ORACLES["version_jobs"] = (
    "with v as (select max(n_nationkey) + 1 as id from nation), days as (select distinct user_id % 3 as v, cast(cast(ts as timestamp) as date) as d from events where event_id % 2 = 0) "
    "select 'events' as stored, cast(user_id % 3 as bigint) as version_id, count(*) filter (event_type = 'view') + count(*) filter (event_id % 2 = 0) as n from events where user_id % 3 <> 0 group by 2 "
    "union all select 'event_sketches', v, count(*) from days where v <> 0 group by v "
    "union all select 'players', c_custkey % 3, count(*) from customer where c_custkey % 3 <> 0 group by 2 "
    "union all select 'players', (select id from v), count(*) from customer where c_custkey % 2 = 1 "
    "union all select 'users', null, count(*) from customer "
    "union all select 'draft', (select id from v), 1"
)


def stored_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as an import stores them: texts trimmed at any depth, blank ones null, no container for scalars."""
    payload = (
        "case event_id % 8 when 0 then '{\"a\": \"  x' || event_id || ' \", \"b\": {\"c\": \" \", \"d\": [\" y\", 2, \"z \"]}}' "
        "when 1 then '  {}  ' when 2 then '\"text\"' when 3 then null when 4 then '[\" q \", {\"k \": \"\"}]' "
        "when 5 then '{\"plain\": ' || event_id || '}' when 6 then '{\"q\": \" say \\\\\"hi\\\\\" \"}' else '{\"t\": \"\\\\t x\\\\n\"}' end"
    )
    rows = st.load(spark, sf_dir, "events").selectExpr("event_id", f"{payload} as payload")
    return with_stored_payload(rows).select("event_id", "payload")


QUERIES["stored_payloads"] = stored_payloads
ORACLES["stored_payloads"] = (
    "select event_id, case event_id % 8 when 0 then '{\"a\": \"x' || event_id || '\", \"b\": {\"c\": null, \"d\": [\"y\", 2, \"z\"]}}' "
    "when 4 then '[\"q\", {\"k \": null}]' when 5 then '{\"plain\": ' || event_id || '}' when 6 then '{\"q\": \"say \\\"hi\\\"\"}' when 7 then '{\"t\": \"x\"}' else '[]' end as payload from events"
)
