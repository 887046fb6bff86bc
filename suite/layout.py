"""Queries over the store's layout: imports that die half way, merge on read, the key index, kept scores, typed rows."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlake.ingest.jobs import Job, replay, run_import
from campaignlake.operators.sketches import unique_players
from campaignlake.plans.ranks import build_ranks, ranked_page
from campaignlake.plans.sheet import compile_sheet
from campaignlake.plans.spec import parse_spec
from campaignlake.plans.workbook import export_workbook, read_sheet
from campaignlake.settings import Settings
from campaignlake.sources.registry import DEFAULT_REGISTRY
from campaignlake.sources.tables import CampaignStore, latest
from campaignlake.streaming.ingest_stream import start_keyed_events
from suite import standins as st
from suite.ingestion import TYPED_SQL, value
from suite.sheets import E_LANG, E_SCORE, E_UTM, Query, avg2
from suite.standins import ctes
from suite.stored import event_rows, failing, seeded_store, work_folder

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Killed(BaseException):
    """A driver's death between two writes: no handler of the job sees it."""


class CutStore(CampaignStore):
    """A store whose driver dies as soon as one table has been written."""

    deadly = "events"

    def append_log(self, rows: DataFrame, table: str, batch_id: str, number: int) -> None:
        super().append_log(rows, table, batch_id, number)
        if table == self.deadly and batch_id == "X":
            raise Killed


def _gift_rows(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """Events of which every tenth grants a reward."""
    rows = event_rows(spark, sf_dir, where, "case when event_id % 10 = 0 then 'reward_granted' else 'tap' end")
    return rows.withColumn("payload", F.expr("case when type = 'reward_granted' then '{\"reward_type\": \"badge\"}' end"))


def import_cut_between_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X dies after its events are written and before its rewards are; Y takes some of its keys; X runs again. Rows of
    both tables by batch after each step."""
    folder = work_folder(spark)
    seeded_store(spark, sf_dir, folder)
    store, cut = CampaignStore(spark, f"{folder}/lake"), CutStore(spark, f"{folder}/lake")
    x, y = _gift_rows(spark, sf_dir, "event_id % 2 = 0"), event_rows(spark, sf_dir, "event_id % 3 = 0", "'swipe'")
    seen = []

    def look(step: str) -> None:
        # Taken as each step left it: later imports do not change what a snapshot reads.
        for table in ("events", "rewards"):
            rows = store.read(table).where("batch_id <> 'seed'")
            seen.append(rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), F.lit(table).alias("stored"), "batch_id", "n"))

    try:
        run_import(cut, "events", x, "X")
    except Killed:
        look("1 cut")
    run_import(store, "events", y, "Y")
    look("2 other")
    run_import(store, "events", x, "X")
    look("3 again")
    return reduce(DataFrame.unionByName, seen)


QUERIES["import_cut_between_tables"] = import_cut_between_tables
ORACLES["import_cut_between_tables"] = (
    "with n as (select count(*) filter (event_id % 3 = 0) as y, count(*) filter (event_id % 2 = 0 and event_id % 3 <> 0) as x, "
    "count(*) filter (event_id % 10 = 0 and event_id % 3 <> 0) as r from events) "
    "select '2 other' as step, 'events' as stored, 'Y' as batch_id, y as n from n union all select '3 again', 'events', 'Y', y from n "
    "union all select '3 again', 'events', 'X', x from n union all select '3 again', 'rewards', 'X', r from n"
)


def import_replayed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same keys in four imports, the last a small one: a key is stored by the first that has it, whatever split
    of the index it falls into; rows without a key come again with each import."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    keyless = "case when event_id % 7 <> 0 then dedup_key end"
    for name, where in (("A", "event_id % 2 = 0"), ("B", "event_id % 2 = 0 or event_id % 3 = 0"), ("C", "true"), ("D", "event_id % 40 = 0")):
        run_import(store, "events", event_rows(spark, sf_dir, where, "'tap'").withColumn("dedup_key", F.expr(keyless.replace("event_id", "ord"))), name)
    return store.read("events").where("batch_id <> 'seed'").groupBy("batch_id", "dedup_key").agg(F.count(F.lit(1)).alias("n"))


QUERIES["import_replayed_keys"] = import_replayed_keys
ORACLES["import_replayed_keys"] = (
    "with i as (select *, unnest(['A', 'B', 'C', 'D']) as b from events), "
    "given as (select * from i where (b = 'A' and event_id % 2 = 0) or (b = 'B' and (event_id % 2 = 0 or event_id % 3 = 0)) or b = 'C' "
    "or (b = 'D' and event_id % 40 = 0)), "
    "keyed as (select min(b) as batch_id, 'n' || cast(event_id as string) as dedup_key, cast(1 as bigint) as n from given "
    "where event_id % 7 <> 0 group by event_id) "
    "select * from keyed union all select b, null, count(*) from given where event_id % 7 = 0 group by b"
)


def _languages(customers: DataFrame, where: str, language: str) -> DataFrame:
    return customers.where(where).selectExpr(
        "lower(c_name) || '@example.com' as email", "'x' || cast(c_custkey as string) as external_id", "cast(null as string) as registered_at",
        f"'{language}' as language", "c_custkey % 3 as version_id", "c_custkey as ord",
    )


def players_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base, three imports of changes over it, one that failed; read before and after the changes are folded in, and
    again after one more change."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    customers = st.load(spark, sf_dir, "customer")
    for language, where in (("sv", "c_custkey % 2 = 0"), ("da", "c_custkey % 3 = 0"), ("nb", "c_custkey % 5 = 0")):
        run_import(store, "players", _languages(customers, where, language), language)
    broken = Job.publish

    def publish(job: Job) -> None:
        broken(job)
        raise RuntimeError("after all changes are written")

    Job.publish = publish
    try:
        failing(lambda: run_import(store, "players", _languages(customers, "true", "zz"), "zz"))
    finally:
        Job.publish = broken

    def look(step: str) -> DataFrame:
        players = store.read("players").groupBy("version_id", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("total_score").alias("score"))
        path = f"{store.root}/look/{step}"
        players.withColumn("step", F.lit(step)).write.parquet(path)
        return spark.read.parquet(path)

    before = look("deltas")
    store.compact("players"), store.compact("users")
    folded = look("folded")
    run_import(store, "players", _languages(customers, "c_custkey % 7 = 0", "is"), "is")
    return reduce(DataFrame.unionByName, [before, folded, look("one more")])


QUERIES["players_merge_on_read"] = players_merge_on_read
ORACLES["players_merge_on_read"] = (
    ctes("players")
    + ", changed as (select *, case when id % 5 = 0 then 'nb' when id % 3 = 0 then 'da' when id % 2 = 0 then 'sv' else language end as l from s_players), "
    "steps as (select unnest(['deltas', 'folded', 'one more']) as step) "
    "select step, version_id, case when step = 'one more' and id % 7 = 0 then 'is' else l end as language, count(*) as n, "
    "sum(total_score) as score from changed, steps group by 1, 2, 3"
)


def scores_kept_by_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished games in three imports, the second of which dies once and fails once before it succeeds, and all of
    which repeat keys: every player's total is the old one and each game once. No step scans the events."""
    folder = work_folder(spark)
    seeded_store(spark, sf_dir, folder)
    store, cut = CampaignStore(spark, f"{folder}/lake"), CutStore(spark, f"{folder}/lake")
    games = event_rows(spark, sf_dir, "true", "case when event_id % 4 = 0 then 'tap' else 'game_completed' end").withColumn(
        "payload", F.expr("case when ord % 11 = 0 then '[]' else '{\"score\": ' || cast(ord % 50 as string) || '}' end")
    )
    run_import(store, "events", games.where("ord % 3 = 0"), "first")
    second = games.where("ord % 3 <> 2")
    try:
        run_import(cut, "events", second, "X")
    except Killed:
        pass
    run_import(store, "events", second, "X")
    run_import(store, "events", games, "last")
    return store.read("players").select("version_id", "id", "total_score")


QUERIES["scores_kept_by_imports"] = scores_kept_by_imports
ORACLES["scores_kept_by_imports"] = (
    ctes("players")
    + ", games as (select user_id as id, sum(event_id % 50) as score from events where event_id % 4 <> 0 and event_id % 11 <> 0 group by user_id) "
    "select version_id, id, cast(total_score + coalesce(score, 0) as bigint) as total_score from s_players left join games using (id)"
)


def typed_rows_of_a_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows and skips that an events import stores, twice imported; cells as text, named by the event's key."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    for name in ("questions", "answer_options"):
        fields = store.read(name).schema.fields
        rows = st.table(spark, sf_dir, name)
        store.append(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]), name)
    events = st.typed_events(spark, sf_dir).select(
        F.col("player_id").cast("string").alias("player_id"), F.lit(None).cast("string").alias("player_email"), "type",
        F.replace(F.concat("occurred_at", F.lit("Z")), F.lit(" "), F.lit("T")).alias("occurred_at"),
        F.concat(F.lit("t"), "id").alias("dedup_key"), "payload", F.col("version_id").cast("bigint").alias("version_id"), F.col("id").alias("ord"),
    )
    run_import(store, "events", events.where("ord % 5 <> 0"), "some")
    run_import(store, "events", events, "all")
    keys = store.read("events").select(F.col("id").alias("event_id"), "dedup_key")
    cells = {
        "answers": ["player_id", "question_id", "answer_option_id", "answer_text"],
        "transactions": ["player_id", "type", "amount", "currency", "status"],
        "rewards": ["player_id", "reward_type", "reward_code", "status", "redeemed_at"],
        "typed_skipped": ["type", "reason"],
    }
    parts = [
        store.read(name).select("event_id", F.lit(name).alias("stored"), "version_id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("cells"))
        for name, columns in cells.items()
    ]
    return reduce(DataFrame.unionByName, parts).join(keys, "event_id").select("stored", "version_id", "dedup_key", "cells")


def _cells(*columns: str) -> str:
    return " || '|' || ".join(f"coalesce(cast({c} as string), '')" for c in columns)


QUERIES["typed_rows_of_a_store"] = typed_rows_of_a_store
ORACLES["typed_rows_of_a_store"] = (
    TYPED_SQL
    + f", ok as (select *, cast({value('question_id')} as bigint) as q, cast({value('answer_option_id')} as bigint) as o, "
    f"{value('answer_text')} as txt from a where reason is null), "
    # The first import has the events whose id is no multiple of 5, so their answers come first.
    "ranked as (select *, row_number() over (partition by version_id, player_id, q order by id % 5 = 0, id) as rn from ok) "
    f"select 'answers' as stored, version_id, 't' || id as dedup_key, {_cells('player_id', 'q', 'o', 'txt')} as cells from ranked where rn = 1 "
    f"union all select 'transactions', version_id, 't' || id, {_cells('player_id', value('type'), 'cast(' + value('amount') + ' as decimal(12,2))', value('currency'))} "
    f"|| '|' || coalesce({value('status')}, 'completed') from t where reason is null "
    f"union all select 'rewards', version_id, 't' || id, {_cells('player_id', value('reward_type'), value('reward_code'))} || '|granted|' from r where reason is null "
    + "".join(f"union all select 'typed_skipped', version_id, 't' || id, type || '|' || reason from {x} where reason is not null " for x in "atr")
)


def import_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest state of imports of all outcomes: completed, repeated, failed and tried again."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    rows = event_rows(spark, sf_dir, "event_id % 9 = 0", "'tap'")
    run_import(store, "events", rows, "a")
    run_import(store, "events", rows, "a")
    run_import(store, "events", rows, "b", "quarantine")
    bad = rows.withColumn("occurred_at", F.expr("case when ord % 2 = 0 then 'never' else occurred_at end"))
    run_import(store, "events", bad, "c", "quarantine")
    unknown = Job.publish

    def publish(job: Job) -> None:
        raise RuntimeError("lost")

    Job.publish = publish
    try:
        failing(lambda: run_import(store, "events", rows, "d"))
        failing(lambda: run_import(store, "events", rows, "e"))
    finally:
        Job.publish = unknown
    run_import(store, "events", rows, "e")
    log = latest(store.read("import_log"), "import_id")
    return log.select("import_id", "type", "status", "attempts", "processed_rows", "inserted", "duplicates", "failed", "rejected", "error_message")


QUERIES["import_ledger"] = import_ledger
ORACLES["import_ledger"] = (
    "with n as (select count(*) as n, count(*) filter (event_id % 2 = 0) as bad from events where event_id % 9 = 0) "
    "select 'a' as import_id, 'events' as type, 'completed' as status, 1 as attempts, n as processed_rows, n as inserted, 0 as duplicates, 0 as failed, "
    "0 as rejected, cast(null as string) as error_message from n "
    "union all select 'b', 'events', 'completed', 1, n, 0, n, 0, 0, null from n "
    "union all select 'c', 'events', 'completed', 1, n - bad, 0, n - bad, 0, bad, null from n "
    "union all select 'd', 'events', 'failed', 1, null, null, null, null, null, 'lost' from n "
    "union all select 'e', 'events', 'completed', 2, n, 0, n, 0, 0, null from n"
)


def stream_keys_across_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded-state dedup in three runs of one stream. The second run repeats rows of the first, whose keys are
    still remembered, and brings new rows and rows older than the watermark; the third repeats the first's rows when they
    are too old themselves."""
    folder = work_folder(spark)
    events = st.load(spark, sf_dir, "events").selectExpr(
        "user_id % 3 as version_id", "case when event_id % 9 <> 0 then 'n' || cast(event_id as string) end as dedup_key", "event_id"
    )
    at = lambda start: F.expr(f"timestamp'{start}' + make_interval(0, 0, 0, 0, 0, cast(event_id % 600 as int), 0)")
    first = events.withColumn("occurred_at", at("2026-01-01 00:00:00"))
    late = events.where("event_id % 4 = 0").withColumn("occurred_at", at("2025-12-01 00:00:00")).withColumn("dedup_key", F.expr("'late' || dedup_key"))
    new = events.where("event_id % 5 = 0").withColumn("occurred_at", at("2026-01-03 00:00:00")).withColumn("dedup_key", F.expr("'new' || dedup_key"))
    runs = [first.unionByName(first.where("event_id % 2 = 0")), first.where("event_id % 3 = 0").unionByName(late).unionByName(new), first]
    schema = runs[0].schema
    for number, rows in enumerate(runs):
        rows.write.parquet(f"{folder}/landing/run={number}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/landing/*")
        start_keyed_events(stream, f"{folder}/keyed", f"{folder}/checkpoint").awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{folder}/keyed")
    return rows.groupBy("version_id", "dedup_key").agg(F.count(F.lit(1)).alias("n"))


QUERIES["stream_keys_across_restarts"] = stream_keys_across_restarts
ORACLES["stream_keys_across_restarts"] = (
    "select user_id % 3 as version_id, 'n' || cast(event_id as string) as dedup_key, 1 as n from events where event_id % 9 <> 0 "
    "union all select user_id % 3, 'newn' || cast(event_id as string), 1 from events where event_id % 9 <> 0 and event_id % 5 = 0 "
    "union all select user_id % 3, null, sum(2 + (event_id % 2 = 0)::int + (event_id % 3 = 0)::int + (event_id % 4 = 0)::int + (event_id % 5 = 0)::int) "
    "from events where event_id % 9 = 0 group by 1"
)


def unique_players_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and players by version and type from the sketches that two overlapping imports kept: the events are exact,
    the players within 5 % of the exact count."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    run_import(store, "events", event_rows(spark, sf_dir, "event_id % 3 <> 0", "event_type"), "one")
    run_import(store, "events", event_rows(spark, sf_dir, "event_id % 3 <> 1", "event_type"), "two")
    exact = store.read("events").where("batch_id <> 'seed'").groupBy("version_id", "type").agg(F.count_distinct("player_id").alias("exact"))
    about = unique_players(store.read("event_sketches"), ["version_id", "type"])
    near = F.abs(F.col("unique_players") - F.col("exact")) <= F.greatest(F.lit(1), 0.05 * F.col("exact"))
    return about.join(exact, ["version_id", "type"]).select("version_id", "type", "events", near.alias("near"))


QUERIES["unique_players_sketched"] = unique_players_sketched
ORACLES["unique_players_sketched"] = (
    "select user_id % 3 as version_id, event_type as type, count(*) as events, true as near from events group by 1, 2"
)


def events_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opt-in for approximate distinct counts in a sheet, against the exact ones."""
    sheet = {"source": "events", "group_by": ["type"], "metrics": ["unique_players", "count"]}
    spec = parse_spec({"sheets": [sheet]}).sheets[0]
    about = compile_sheet(spec, st.tables(spark, sf_dir), None, settings=Settings(approx_distinct=0.01)).toDF("version_id", "type", "about", "n")
    exact = compile_sheet(spec, st.tables(spark, sf_dir), None).toDF("version_id", "type", "exact", "n_exact")
    near = F.abs(F.col("about") - F.col("exact")) <= F.greatest(F.lit(1), 0.05 * F.col("exact"))
    return about.join(exact, ["version_id", "type"]).select("version_id", "type", "n", near.alias("near"))


QUERIES["events_approx_distinct"] = events_approx_distinct
ORACLES["events_approx_distinct"] = (
    ctes("events") + "select version_id, type, count(*) as n, true as near from s_events group by 1, 2"
)


FIVE_SHEETS = {
    "sheets": [
        {"name": "By type", "source": "events", "group_by": ["type"], "metrics": ["count", "unique_players", "avg_score"]},
        {"name": "Languages", "source": "events", "group_by": ["language", "type"], "filters": {"type": ["click", "view"]}, "metrics": ["count"]},
        {"name": "Scores", "source": "events", "filters": {"language": ["it"]},
         "columns": [{"fn": "min", "field": "score", "as": "low"}, {"fn": "max", "field": "score", "as": "high"}, {"fn": "sum", "field": "score", "as": "sum"}, {"fn": "count", "as": "n"}]},
        {"name": "Nobody", "source": "events", "filters": {"type": ["no such type"]}, "metrics": ["count", "unique_players", "avg_score"]},
        {"name": "Pairs", "source": "events", "group_by": ["type", "utm_source"]},
    ],
}


def workbook_of_one_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a workbook of five aggregated sheets over one source, which read it once."""
    path = f"{work_folder(spark)}/export"
    written = export_workbook(spark, FIVE_SHEETS, st.tables(spark, sf_dir), 1, path)
    sheets = []
    for w in written:
        cells = [f"c{i}" for i in range(len(w.header))]
        rows = read_sheet(spark, path, w.number).toDF(*cells)
        sheets.append(rows.select(F.lit(w.number).alias("sheet_no"), F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in cells]).alias("cells")))
    return reduce(DataFrame.unionByName, sheets)


QUERIES["workbook_of_one_source"] = workbook_of_one_source
ORACLES["workbook_of_one_source"] = (
    ctes("events")
    + f", e as (select *, {E_LANG} as language, {E_UTM} as utm, {E_SCORE} as score from s_events where version_id = 1) "
    f"select 1 as sheet_no, concat_ws('|', type, count(*), count(distinct player_id), coalesce(cast({avg2('sum(score)', 'count(score)')} as string), '')) as cells "
    "from e group by type "
    "union all select 2, concat_ws('|', coalesce(language, ''), type, count(*)) from e where type in ('click', 'view') group by language, type "
    "union all select 3, concat_ws('|', min(score), max(score), sum(score), count(*)) from e where language = 'it' "
    "union all select 4, '0|0|' "
    "union all select distinct 5, concat_ws('|', type, coalesce(utm, '')) from e"
)


PAGES = (1, 2, 3, 7, 9, 10_000)


def players_ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the listing at several depths out of key ranges, after players have changed and others have come since
    the ranges were built."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    for version in range(3):
        build_ranks(store, version, rows_per_range=7)
    customers = st.load(spark, sf_dir, "customer")
    changed = _languages(customers, "c_custkey % 4 = 0", "sv")
    fresh = customers.where("c_custkey % 5 = 0").selectExpr(
        "'new' || cast(c_custkey as string) || '@example.com' as email", "cast(null as string) as external_id", "cast(null as string) as registered_at",
        "'xx' as language", "c_custkey % 3 as version_id", "1000000 + c_custkey as ord",
    )
    run_import(store, "players", changed.unionByName(fresh), "later")
    pages = [
        ranked_page(store, version, page, 6).select(F.lit(version).alias("version_id"), F.lit(page).alias("page"), "email", "language")
        for version in range(3) for page in PAGES
    ]
    return reduce(DataFrame.unionByName, pages)


QUERIES["players_ranked_pages"] = players_ranked_pages
ORACLES["players_ranked_pages"] = (
    ctes("players", "users")
    + ", whole as (select version_id, p.id, email, case when p.id % 4 = 0 then 'sv' else language end as language from s_players p join s_users u on u.id = p.user_id "
    "union all select c_custkey % 3, 1000000000 + c_custkey, 'new' || c_custkey || '@example.com', 'xx' from customer where c_custkey % 5 = 0), "
    "numbered as (select *, cast((row_number() over (partition by version_id order by id) - 1) // 6 + 1 as int) as page from whole) "
    f"select cast(version_id as int) as version_id, page, email, language from numbered where page in {PAGES}"
)


def replay_under_new_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for typed rows changes after an import: what the replay of its raw batch adds, changes and removes, and
    the typed rows that are stored then."""
    store = seeded_store(spark, sf_dir, work_folder(spark))
    rows = event_rows(spark, sf_dir, "true", "case when event_id % 3 = 0 then 'reward_granted' else 'transaction' end").withColumn(
        "payload",
        F.expr(
            "case when ord % 3 = 0 then '{\"reward_type\": \"badge\"' || case when ord % 2 = 0 then ', \"reward_code\": \"c\"' else '' end || '}' "
            "else '{\"amount\": 2, \"currency\": \"EUR\", \"type\": \"' || case when ord % 5 = 0 then 'gift' else 'spend' end || '\"}' end"
        ),
    )
    run_import(store, "events", rows, "x")
    run_import(store, "events", rows.where("ord % 7 = 0"), "again")
    typed = DEFAULT_REGISTRY.typed
    payment, reward = typed["transaction"], typed["reward_granted"]
    gifts = replace(
        payment, statics={"status": "pending"}, fields=tuple(replace(f, one_of=("gift", "purchase")) if f.key == "type" else f for f in payment.fields)
    )
    codes = replace(reward, fields=tuple(replace(f, required=True) for f in reward.fields))
    changes = replay(store, "x", registry=replace(DEFAULT_REGISTRY, typed={**typed, "transaction": gifts, "reward_granted": codes}))
    stored = [store.read(t).select(F.lit(t).alias("stored"), F.lit("stored").alias("change")) for t in ("events", "transactions", "rewards", "typed_skipped")]
    return reduce(DataFrame.unionByName, [changes.drop("id"), *stored]).groupBy("stored", "change").agg(F.count(F.lit(1)).alias("n"))


QUERIES["replay_under_new_rules"] = replay_under_new_rules
ORACLES["replay_under_new_rules"] = (
    "with n as (select count(*) as n, count(*) filter (event_type = 'view') as seeds, count(*) filter (event_id % 3 <> 0 and event_id % 5 = 0) as gifts, "
    "count(*) filter (event_id % 3 <> 0 and event_id % 5 <> 0) as spends, count(*) filter (event_id % 3 = 0 and event_id % 2 = 0) as coded, "
    "count(*) filter (event_id % 3 = 0 and event_id % 2 <> 0) as bare from events) "
    "select 'transactions' as stored, 'added' as change, gifts as n from n union all select 'transactions', 'removed', spends from n "
    "union all select 'rewards', 'removed', bare from n union all select 'events', 'stored', n + seeds from n "
    "union all select 'transactions', 'stored', gifts from n union all select 'rewards', 'stored', coded from n "
    "union all select 'typed_skipped', 'stored', spends + bare from n"
)
