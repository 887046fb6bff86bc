"""Queries that run the stored pipeline: streaming ingestion and workbook export.

They write to the folder that the session names in `spark.checkpoint.dir`; a temporary folder
stands in where that is unset, as in local tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlake import schemas
from campaignlake.ingest.jobs import run_import
from campaignlake.plans.workbook import WrittenSheet, export_workbook, manifest_frame, read_sheet
from campaignlake.settings import Settings
from campaignlake.sources.registry import DEFAULT_REGISTRY
from campaignlake.sources.tables import CampaignStore
from campaignlake.streaming.ingest_stream import start_ingest
from suite import standins as st
from suite.ingestion import KNOWN
from suite.sheets import BETWEEN, E_LANG, E_SCORE, WORKBOOK, WORKBOOK_COUNTS, Query
from suite.standins import DUCK, ctes, work_folder

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def seeded_store(spark: SparkSession, sf_dir: str, folder: str, variants: bool = False) -> CampaignStore:
    """Users, players and an already ingested batch of events."""
    store = CampaignStore(spark, f"{folder}/lake", buckets=8, variants=variants)
    stamps = {"created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp")}
    versions = st.load(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as id")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.VERSIONS if f.name != "id"]
    store.append(versions.select("id", *empty).coalesce(1), "versions")
    store.replace_buckets(st.table(spark, sf_dir, "users").withColumns(stamps), "users")
    store.replace_buckets(st.table(spark, sf_dir, "players").withColumns(stamps), "players")
    stored = st.load(spark, sf_dir, "events").where("event_type = 'view'").selectExpr(
        "event_id as id", "user_id % 3 as version_id", "user_id as player_id", "event_type as type",
        "cast(ts as timestamp) as occurred_at", "'[]' as payload", "'e' || cast(event_id as string) as dedup_key",
        "cast(null as timestamp) as created_at", "cast(null as string) as payload_language",
        "cast(null as string) as payload_utm_source", "cast(null as int) as payload_score",
    )
    store.write_batch(stored, "events", "seed")
    return store


def stream_ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event batch through a file stream into a store; returns the rows it appended."""
    folder = work_folder(spark)
    store = seeded_store(spark, sf_dir, folder)
    landing = f"{folder}/landing"
    st.event_batch(spark, sf_dir).write.parquet(landing)
    rows = spark.readStream.schema(spark.read.parquet(landing).schema).parquet(landing)

    def ingest(batch: DataFrame, number: int) -> None:
        run_import(store, "events", batch, f"stream-{number}", "quarantine")

    query = (
        rows.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return (
        store.read("events")
        .where("batch_id <> 'seed'")
        .select(
            "id", "version_id", "player_id", "type",
            F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("occurred_at"), "payload", "dedup_key",
            F.col("payload_language").alias("language"), F.col("payload_score").alias("score"),
        )
    )


QUERIES["stream_ingest_events"] = stream_ingest_events
ORACLES["stream_ingest_events"] = (
    KNOWN + "select (select max(event_id) from events where event_type = 'view') + 1 + ord as id, version_id, "
    f"pid as player_id, type, {DUCK['SEC'].format('cast(occurred_at as timestamp)')} as occurred_at, "
    "payload, k as dedup_key, "
    "json_extract_string(payload, '$.language') as language, "
    "cast(json_extract_string(payload, '$.score') as int) as score from fresh"
)


def _exported(spark: SparkSession, sf_dir: str) -> tuple[str, list[WrittenSheet]]:
    path = f"{work_folder(spark)}/export"
    written = export_workbook(spark, WORKBOOK, st.tables(spark, sf_dir), 1, path)
    return path, written


def workbook_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export of a request over all sources for one version; returns its manifest."""
    _, written = _exported(spark, sf_dir)
    return manifest_frame(spark, written).select("sheet_no", "name", "rows", F.size("header").alias("columns"))


QUERIES["workbook_manifest"] = workbook_manifest
ORACLES["workbook_manifest"] = (
    WORKBOOK_COUNTS + 'select sheet_no, metric as name, n as "rows", '
    "[4, 3, 3, 3][sheet_no] as columns from counts where version_id = 1"
)


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the exported workbook, read back from its files: sheet number and the row's cells in order."""
    path, written = _exported(spark, sf_dir)
    sheets = [
        read_sheet(spark, path, w.number).toDF(*[f"c{i}" for i in range(len(w.header))])
        .select(F.lit(w.number).alias("sheet_no"), F.array([F.coalesce(f"c{i}", F.lit("")) for i in range(len(w.header))]).alias("cells"))
        .select("sheet_no", F.array_join("cells", "|").alias("cells"))
        for w in written
    ]
    return reduce(DataFrame.unionByName, sheets)


QUERIES["workbook_cells"] = workbook_cells
ORACLES["workbook_cells"] = (
    WORKBOOK_COUNTS + "select 1 as sheet_no, concat_ws('|', currency, status, cast(sum(amount) as decimal(20, 2)), count(*)) as cells "
    f"from s_transactions where version_id = 1 and {BETWEEN} group by currency, status "
    "union all select 2, concat_ws('|', id, total_score, coalesce(language, '')) from s_players where version_id = 1 "
    f"union all select 3, concat_ws('|', id, player_id, coalesce(cast({E_SCORE} as string), '')) from s_events "
    f"where version_id = 1 and {BETWEEN} and type = 'click' and {E_LANG} in ('en', 'es') "
    "union all select 4, concat_ws('|', question_id, count(distinct player_id), count(*)) from s_answers "
    f"where version_id = 1 and {BETWEEN} group by question_id"
)


# --- imports that fail, come again, or hold broken documents -----------------------------------------------


def _unique_ids(rows: DataFrame) -> DataFrame:
    """One row: whether all rows have ids of their own."""
    return rows.agg((F.count(F.lit(1)) == F.count_distinct("id")).alias("ok"))


def failing(run: Callable[[], object]) -> None:
    try:
        run()
    except Exception:
        return
    raise AssertionError("the import was meant to fail")


PLAYERS_X = (
    "select 'x' || cast(c_custkey as string) || '@new.example' as email, 'nx' || cast(c_custkey as string) as external_id, "
    "cast(null as string) as registered_at, 'sv' as language, c_custkey % 3 as version_id, c_custkey as ord from customer where c_custkey % 4 = 0 "
    "union all select lower(c_name) || '@example.com', 'x' || cast(c_custkey as string), cast(null as string), 'sv', c_custkey % 3, "
    "1000000 + c_custkey from customer where c_custkey % 9 = 1"
)
PLAYERS_Y = (
    "select 'x' || cast(c_custkey as string) || '@new.example' as email, 'nx' || cast(c_custkey as string) as external_id, "
    "cast(null as string) as registered_at, 'da' as language, c_custkey % 3 as version_id, c_custkey as ord from customer where c_custkey % 6 = 0"
)


def import_retry_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X fails after it staged users, Y runs, X runs again: nobody is lost, nothing is doubled."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    st.load(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    x, y = spark.sql(PLAYERS_X), spark.sql(PLAYERS_Y)
    failing(lambda: run_import(store, "players", x, "X", settings=Settings(chunk_size=0)))
    run_import(store, "players", y, "Y")
    run_import(store, "players", x, "X")
    users, players = store.read("users"), store.read("players").drop("bucket")
    named = players.join(users.select(F.col("id").alias("user_id"), "email"), "user_id").select("email", "version_id", "language")
    unique = _unique_ids(users).crossJoin(_unique_ids(players).withColumnRenamed("ok", "ok2"))
    return named.crossJoin(unique.select((F.col("ok") & F.col("ok2")).alias("ids_unique")))


QUERIES["import_retry_players"] = import_retry_players
ORACLES["import_retry_players"] = (
    ctes("users", "players")
    + f", x as ({PLAYERS_X}), y as ({PLAYERS_Y}), base as (select email, version_id, language from s_players p join s_users u on u.id = p.user_id), "
    "keys as (select email, version_id from base union select email, version_id from x union select email, version_id from y) "
    "select k.email, cast(k.version_id as bigint) as version_id, coalesce(x.language, y.language, b.language) as language, true as ids_unique "
    "from keys k left join x using (email, version_id) left join y using (email, version_id) left join base b using (email, version_id)"
)


def event_rows(spark: SparkSession, sf_dir: str, where: str, kind: str) -> DataFrame:
    return st.load(spark, sf_dir, "events").where(where).selectExpr(
        "cast(user_id as string) as player_id", "cast(null as string) as player_email", f"{kind} as type",
        "date_format(cast(ts as timestamp), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as occurred_at", "'n' || cast(event_id as string) as dedup_key",
        "cast(null as string) as payload", "cast(user_id % 3 as bigint) as version_id", "event_id as ord",
    )


def import_retry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X fails after it wrote its events, Y takes some of its keys, X runs again."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    x = event_rows(spark, sf_dir, "event_id % 2 = 0", "case when event_id % 10 = 0 then 'transaction' else 'tap' end")
    y = event_rows(spark, sf_dir, "event_id % 3 = 0", "'swipe'")
    broken = replace(DEFAULT_REGISTRY, references={"question": "no such table"})
    failing(lambda: run_import(store, "events", x, "X", registry=broken))
    run_import(store, "events", y, "Y")
    run_import(store, "events", x, "X")
    rows = store.read("events")
    return rows.where("batch_id <> 'seed'").select("version_id", "player_id", "type", "dedup_key", "batch_id").crossJoin(
        _unique_ids(rows).withColumnRenamed("ok", "ids_unique")
    )


QUERIES["import_retry_events"] = import_retry_events
ORACLES["import_retry_events"] = (
    "select cast(user_id % 3 as bigint) as version_id, user_id as player_id, case when event_id % 3 = 0 then 'swipe' "
    "when event_id % 10 = 0 then 'transaction' else 'tap' end as type, 'n' || cast(event_id as string) as dedup_key, "
    "case when event_id % 3 = 0 then 'Y' else 'X' end as batch_id, true as ids_unique from events where event_id % 2 = 0 or event_id % 3 = 0"
)


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents, some of them broken, through the stream: what was stored and what was refused."""
    folder = work_folder(spark)
    store = seeded_store(spark, sf_dir, folder)
    rows = event_rows(spark, sf_dir, "true", "event_type").withColumn("doc", F.col("player_id").cast("bigint") % 60)
    body = F.struct("player_id", "type", "occurred_at", "dedup_key")
    documents = rows.groupBy("doc", "version_id").agg(F.collect_list(body).alias("events"))
    whole = F.to_json(F.struct("version_id", "events"))
    text = (
        F.when(F.col("doc") == 6, F.expr("left(whole, length(whole) - 9)"))
        .when(F.col("doc") == 7, F.replace("whole", F.lit('"events":['), F.lit('"events":{"0":[')))
        .when(F.col("doc") == 8, F.to_json(F.struct(F.struct("version_id").alias("events"), "version_id")))
        .when(F.col("doc") == 9, F.to_json(F.struct(F.lit("one").alias("version_id"), "events")))
        .when(F.col("doc") == 10, F.to_json(F.struct(F.lit(999).alias("version_id"), "events")))
        .when(F.col("doc") == 11, F.to_json(F.struct("version_id", F.lit("x").alias("rows"))))
        .otherwise(F.col("whole"))
    )
    written = documents.withColumn("whole", whole).select("doc", text.alias("value"))
    landing = f"{folder}/documents"
    written.repartition("doc").write.partitionBy("doc").text(landing)
    start_ingest(store, "events", f"{landing}/*", f"{folder}/checkpoint", max_files=25).awaitTermination()
    stored = store.read("events").where("batch_id <> 'seed'").select(F.lit("stored").alias("outcome"), F.col("dedup_key").alias("name"))
    refused = spark.read.parquet(store.path("rejected/documents/events/*")).select(F.lit("refused").alias("outcome"), F.col("reason").alias("name"))
    return stored.unionByName(refused).groupBy("outcome", "name").agg(F.count(F.lit(1)).alias("n"))


QUERIES["ingest_documents"] = ingest_documents
ORACLES["ingest_documents"] = (
    "with d as (select *, user_id % 60 as doc from events), found as (select distinct doc from d) "
    "select 'stored' as outcome, 'n' || cast(event_id as string) as name, count(*) as n from d where doc not between 6 and 11 group by 2 "
    "union all select 'refused', case when doc in (6, 7, 8) then 'unreadable' when doc = 11 then 'no rows' else 'unknown version' end, count(*) "
    "from found where doc between 6 and 11 group by 2"
)

PAYMENTS = (
    "select cast(o_custkey as string) as player_id, cast(null as string) as player_email, "
    "case when o_orderkey % 11 = 0 then 'gift' else 'purchase' end as type, cast(o_totalprice as string) as amount, 'EUR' as currency, "
    "cast(null as string) as status, cast(null as string) as external_ref, '2026-01-15T10:00:00Z' as occurred_at, "
    "'t' || cast(o_orderkey % 5000 as string) as dedup_key, o_custkey % 3 as version_id, o_orderkey as ord from orders"
)
PRIZES = (
    "select case when o_orderkey % 13 = 0 then '99999999' else cast(o_custkey as string) end as player_id, cast(null as string) as player_email, "
    "'badge' as reward_type, cast(null as string) as reward_code, cast(null as string) as status, '2026-01-15T10:00:00Z' as granted_at, "
    "cast(null as string) as redeemed_at, 'r' || cast(o_orderkey % 3000 as string) as dedup_key, o_custkey % 3 as version_id, o_orderkey as ord from orders"
)


def import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of transactions and rewards imports, each run twice, and the rows that are stored."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    st.load(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    rows = []
    for table, sql in (("transactions", PAYMENTS), ("rewards", PRIZES)):
        for run in (1, 2):
            c = run_import(store, table, spark.sql(sql), f"{table}-{run}", "quarantine")
            rows.append((table, run, c.processed, c.inserted, c.duplicates, c.failed, c.rejected, store.read(table).count()))
    return spark.createDataFrame(rows, '"table" string, run int, processed long, inserted long, duplicates long, failed long, rejected long, stored long'.replace('"', "`"))


def _counter_sql(table: str, sql: str, bad: str, unknown: str) -> str:
    """Both runs of one import: the first inserts one row for each key of known players, the second none."""
    return (
        f"select '{table}' as \"table\", run, count(*) filter (not {bad}) as processed, case when run = 1 then any_value(k.n) else 0 end as inserted, "
        f"count(*) filter (not {bad} and not {unknown}) - case when run = 1 then any_value(k.n) else 0 end as duplicates, "
        f"count(*) filter (not {bad} and {unknown}) as failed, count(*) filter ({bad}) as rejected, any_value(k.n) as stored "
        f"from ({sql}) b, (values (1), (2)) r(run), (select count(distinct (version_id, dedup_key)) as n from ({sql}) where not {bad} and not {unknown}) k group by run"
    )


QUERIES["import_counters"] = import_counters
ORACLES["import_counters"] = (
    _counter_sql("transactions", PAYMENTS, "(type = 'gift')", "false")
    + " union all "
    + _counter_sql("rewards", PRIZES, "false", "(player_id = '99999999')")
)
