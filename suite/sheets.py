"""Sheet, preview and paging queries, for all versions in one pass unless paging needs one."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campaignlake.plans.guards import check_spec
from campaignlake.plans.preview import (
    player_keyset_page,
    player_listing,
    player_page,
    preview,
    preview_frame,
    sheet_page,
)
from campaignlake.plans.sheet import compile_sheet, sheet_row_count
from campaignlake.plans.spec import parse_spec
from campaignlake.plans.workbook import sheet_counts
from campaignlake.settings import DEFAULT_SETTINGS, Settings
from campaignlake.sources.registry import DEFAULT_REGISTRY, FilterDef, JoinDef, Registry, SourceDef
from campaignlake.operators.predicates import has_prefix
from campaignlake.sources.tables import for_version, live_versions, version_by_uuid
from suite import standins as st
from suite.standins import ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

E_LANG = "json_extract_string(payload, '$.language')"
E_UTM = "json_extract_string(payload, '$.utm_source')"
E_SCORE = "try_cast(json_extract_string(payload, '$.score') as int)"


def avg2(total: str, n: str) -> str:
    """Exact average of non-negative integers, rounded half-up to 4 digits and then to 2."""
    return f"cast((2*((2*({total})*10000+({n}))//(2*({n})))+100)//200 as double)/100"


def money_avg2(cents: str, n: str) -> str:
    """The same for amounts in cents: 6 digits first, then 2."""
    return f"cast((2*((2*({cents})*10000+({n}))//(2*({n})))+10000)//20000 as double)/100"


def run_sheet(
    spark: SparkSession,
    sf_dir: str,
    params: dict[str, Any],
    version_id: int | None = None,
    registry: Registry = DEFAULT_REGISTRY,
    settings: Settings = DEFAULT_SETTINGS,
) -> DataFrame:
    check_spec(params, settings, registry)
    spec = parse_spec(params, "2024-01-31", registry).sheets[0]
    return compile_sheet(spec, st.tables(spark, sf_dir), version_id, registry, settings)


def count_sheet(spark: SparkSession, sf_dir: str, params: dict[str, Any]) -> DataFrame:
    spec = parse_spec(params, "2024-01-31").sheets[0]
    return sheet_row_count(spec, st.tables(spark, sf_dir), None)


def add_sheet(
    name: str, sheet: dict[str, Any] | None, oracle: str, version_id: int | None = None,
    doubles: tuple[str, ...] = (), settings: Settings = DEFAULT_SETTINGS, **params: Any
) -> None:
    request = {**({"sheets": [sheet]} if sheet is not None else {}), **params}

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = run_sheet(spark, sf_dir, request, version_id, settings=settings)
        return frame.withColumns({c: F.col(c).cast("double") for c in doubles}) if doubles else frame

    QUERIES[name] = query
    ORACLES[name] = oracle


EVENTS = ctes("events")
SUMMARY_METRICS = ["count", "unique_players", "avg_score"]
SUMMARY_SQL = f'count(*) as "count", count(distinct player_id) as unique_players, {avg2(f"sum({E_SCORE})", f"count({E_SCORE})")} as avg_score'

add_sheet(
    "events_summary",
    {"name": "events_summary", "group_by": ["type", "payload.language"], "metrics": SUMMARY_METRICS},
    EVENTS + f"select version_id, type, {E_LANG} as language, {SUMMARY_SQL} from s_events group by 1, 2, 3",
)
add_sheet(
    "events_summary_one_version",
    {"name": "events_summary", "group_by": ["type", "payload.language"], "metrics": SUMMARY_METRICS},
    EVENTS + f"select type, {E_LANG} as language, {SUMMARY_SQL} from s_events where version_id = 1 group by 1, 2",
    version_id=1,
)
add_sheet(
    "events_summary_json_dims",
    {"source": "events", "group_by": ["type", "language", "utm_source"], "metrics": SUMMARY_METRICS},
    EVENTS + f"select version_id, type, {E_LANG} as language, {E_UTM} as utm_source, {SUMMARY_SQL} "
    "from s_events group by 1, 2, 3, 4",
)
add_sheet(
    "events_detail_default",
    None,
    EVENTS + f"select version_id, id, type, occurred_at, {E_LANG} as language, {E_SCORE} as score from s_events",
    date_from="2024-01-10",
)
add_sheet(
    "events_detail_filtered_in",
    {
        "source": "events",
        "columns": ["id", "payload.score", {"field": "utm_source", "as": "utm"}],
        "filters": {"payload.language": ["it", "es"], "type": ["click", "purchase"], "utm_source": "google"},
    },
    EVENTS + f"select version_id, id, {E_SCORE} as score, {E_UTM} as utm from s_events "
    f"where {E_LANG} in ('it', 'es') and type in ('click', 'purchase') and {E_UTM} = 'google'",
)
add_sheet(
    "events_filter_eq_score",
    {"source": "events", "columns": ["id", "player_id"], "filters": {"score": 42}},
    EVENTS + f"select version_id, id, player_id from s_events where {E_SCORE} = 42",
)
add_sheet(
    "events_filter_null_score",
    {"source": "events", "columns": ["id", "type"], "filters": {"score": None}},
    EVENTS + f"select version_id, id, type from s_events where {E_SCORE} is null",
)
add_sheet(
    "events_date_range",
    {"source": "events", "group_by": ["type"], "metrics": ["count"]},
    EVENTS + 'select version_id, type, count(*) as "count" from s_events '
    "where occurred_at >= timestamp '2024-01-05' and occurred_at <= timestamp '2024-01-20' group by 1, 2",
    date_from="2024-01-05", date_to="2024-01-20",
)
add_sheet(
    "events_date_range_whole_day",
    {"source": "events", "group_by": ["type"], "metrics": ["count"]},
    EVENTS + 'select version_id, type, count(*) as "count" from s_events '
    "where occurred_at >= timestamp '2024-01-05' and occurred_at < timestamp '2024-01-21' group by 1, 2",
    date_from="2024-01-05", date_to="2024-01-20", settings=Settings(inclusive_end_day=True),
)
add_sheet(
    "events_own_dates_win",
    {
        "source": "events", "group_by": ["language"], "metrics": ["count"],
        "filters": {"occurred_from": "2024-01-12 06:30:00"},
    },
    EVENTS + f'select version_id, {E_LANG} as language, count(*) as "count" from s_events '
    "where occurred_at >= timestamp '2024-01-12 06:30:00' and occurred_at <= timestamp '2024-01-20' group by 1, 2",
    date_from="2024-01-05", date_to="2024-01-20",
)
add_sheet(
    "events_sum_min_max",
    {
        "source": "events",
        "columns": [
            "type",
            {"fn": "sum", "field": "payload.score"},
            {"fn": "min", "field": "score", "as": "lowest"},
            {"fn": "max", "field": "score", "as": "highest"},
            {"fn": "min", "field": "occurred_at", "as": "first_seen"},
            {"fn": "max", "field": "occurred_at", "as": "last_seen"},
            {"fn": "count"},
        ],
        "group_by": ["type"],
        "sort": [],
    },
    EVENTS + f"select version_id, type, sum({E_SCORE}) as sum_score, min({E_SCORE}) as lowest, "
    f"max({E_SCORE}) as highest, min(occurred_at) as first_seen, max(occurred_at) as last_seen, "
    "count(*) as count_all from s_events group by 1, 2",
)
add_sheet(
    "events_global_agg",
    {"source": "events", "columns": [{"fn": "count", "as": "n"}, {"fn": "avg", "field": "score", "as": "mean"},
                                     {"fn": "count_distinct", "field": "type", "as": "types"}]},
    EVENTS + f"select version_id, count(*) as n, {avg2(f'sum({E_SCORE})', f'count({E_SCORE})')} as mean, "
    "count(distinct type) as types from s_events group by 1",
)
add_sheet(
    "events_global_agg_empty",
    {
        "source": "events",
        "columns": [{"fn": "count", "as": "n"}, {"fn": "sum", "field": "score", "as": "total"}],
        "filters": {"type": []},
    },
    EVENTS + f"select count(*) as n, cast(sum({E_SCORE}) as bigint) as total from s_events where false",
    version_id=1,
)
add_sheet(
    "events_distinct_dims",
    {"source": "events", "group_by": ["language", "utm_source"]},
    EVENTS + f"select distinct version_id, {E_LANG} as language, {E_UTM} as utm_source from s_events",
)
add_sheet(
    "events_group_superset",
    {"source": "events", "columns": ["type", {"fn": "count", "as": "n"}], "group_by": ["type", "utm_source"]},
    EVENTS + f"select version_id, type, count(*) as n from s_events group by version_id, type, {E_UTM}",
)


def _ranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = {
        "sheets": [{"source": "events", "columns": ["id", "player_id", "score", "occurred_at"],
                    "sort": ["score:desc", {"column": "occurred_at", "direction": "ASC"}]}]
    }
    # The rank is the place in the sheet itself: parts in order, rows in order inside a part. The sheet is written once,
    # since a sort that is run again, or for fewer columns, may cut its parts elsewhere.
    folder = st.work_folder(spark)
    run_sheet(spark, sf_dir, params, 2).withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder)
    placed = spark.read.parquet(folder)
    part = F.shiftright("_at", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    rank = F.col("start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(starts, "part").withColumn("rank", rank)
    return ranked.drop("_at", "part", "start")


QUERIES["events_sorted_desc_tiebreak"] = _ranked_events
ORACLES["events_sorted_desc_tiebreak"] = (
    EVENTS + f"select id, player_id, {E_SCORE} as score, occurred_at, "
    f"row_number() over (order by {E_SCORE} desc nulls last, occurred_at, id) as rank from s_events where version_id = 2"
)

QUERIES["events_group_count"] = lambda spark, sf: count_sheet(
    spark, sf, {"sheets": [{"source": "events", "group_by": ["type", "language"], "metrics": ["count"]}]}
)
ORACLES["events_group_count"] = (
    EVENTS + f'select version_id, count(*) as "rows" from (select distinct version_id, type, {E_LANG} as l '
    "from s_events) group by 1"
)
QUERIES["events_detail_count"] = lambda spark, sf: count_sheet(
    spark, sf, {"sheets": [{"source": "events", "columns": ["id"], "filters": {"language": "it"}}]}
)
ORACLES["events_detail_count"] = (
    EVENTS + f"select version_id, count(*) as \"rows\" from s_events where {E_LANG} = 'it' group by 1"
)
QUERIES["events_collated_groups"] = lambda spark, sf: (
    compile_sheet(
        parse_spec({"sheets": [{"source": "events", "group_by": ["type"], "metrics": ["count"],
                                "filters": {"type": ["CLICK", "Error"]}}]}).sheets[0],
        st.tables(spark, sf), None, settings=Settings(text_collation="UNICODE_CI"),
    ).withColumn("type", F.lower(F.collate("type", "UTF8_BINARY")))
)
ORACLES["events_collated_groups"] = (
    EVENTS + "select version_id, lower(type) as type, count(*) as \"count\" from s_events "
    "where lower(type) in ('click', 'error') group by 1, 2"
)

PLAYERS = ctes("players", "users")
add_sheet(
    "players_sheet",
    {"name": "players", "columns": ["player_id", "email", "registered_at", "total_score"],
     "filters": {"language": "it"}, "sort": ["total_score:desc"]},
    PLAYERS + "select p.version_id, p.id as player_id, u.email, p.registered_at, p.total_score from s_players p "
    "join s_users u on u.id = p.user_id where p.language = 'it'",
    date_from="2024-01-10",
)
add_sheet(
    "players_language_agg",
    {
        "source": "players",
        "columns": ["language", {"fn": "count", "as": "players"}, {"fn": "sum", "field": "total_score"},
                    {"fn": "avg", "field": "total_score"}, {"fn": "count_distinct", "field": "player_id"}],
        "group_by": ["language"],
    },
    PLAYERS + "select p.version_id, p.language, count(*) as players, sum(total_score) as sum_total_score, "
    f"{avg2('sum(total_score)', 'count(total_score)')} as avg_total_score, "
    "count(distinct p.id) as count_distinct_player_id from s_players p join s_users u on u.id = p.user_id "
    "group by 1, 2",
)

# Sources a user may add: events with the language of their player, if already registered, and
# events that came too early. Both join on a key plus an inequality.
REGISTERED_EVENTS = SourceDef(
    table="events", prepare=DEFAULT_REGISTRY.sources["events"].prepare,
    version_column="events.version_id", key="events.id",
    joins=(
        JoinDef(
            "players", "players",
            (("players.id", "=", "events.player_id"), ("events.occurred_at", ">=", "players.registered_at")),
            "left",
        ),
    ),
    fields={"type": "events.type", "language": "players.language", "player_id": "players.id",
            "score": "payload_score"},
    default_columns=("type", "language"), filters={},
    aggregatable={"count": ("*",), "count_distinct": ("player_id",), "sum": ("score",)}, sort=("type",),
)
EARLY_EVENTS = SourceDef(
    table="events", prepare=DEFAULT_REGISTRY.sources["events"].prepare,
    version_column="events.version_id", key="events.id",
    joins=(
        JoinDef(
            "players", "players",
            (("players.id", "=", "events.player_id"), ("events.occurred_at", "<", "players.registered_at")),
        ),
    ),
    fields={"id": "events.id", "type": "events.type", "language": "players.language"},
    default_columns=("id", "type"), filters={"type": FilterDef("events.type", "in")},
    aggregatable={"count": ("*",)}, sort=("id",),
)
EXTENDED = DEFAULT_REGISTRY.with_source("registered_events", REGISTERED_EVENTS).with_source("early_events", EARLY_EVENTS)
QUERIES["players_left_join"] = lambda spark, sf: run_sheet(
    spark, sf,
    {"sheets": [{"source": "registered_events", "group_by": ["language"], "columns": [
        "language", {"fn": "count", "as": "n"}, {"fn": "count_distinct", "field": "player_id", "as": "players"},
        {"fn": "sum", "field": "score", "as": "score"}]}]},
    registry=EXTENDED,
)
ORACLES["players_left_join"] = (
    ctes("events", "players")
    + "select e.version_id, p.language, count(*) as n, count(distinct p.id) as players, "
    f"sum({E_SCORE}) as score from s_events e left join s_players p on p.id = e.player_id "
    "and e.occurred_at >= p.registered_at group by 1, 2"
)
QUERIES["players_theta_join"] = lambda spark, sf: run_sheet(
    spark, sf, {"sheets": [{"source": "early_events", "columns": ["id", "type", "language"]}]}, registry=EXTENDED
)
ORACLES["players_theta_join"] = (
    ctes("events", "players")
    + "select e.version_id, e.id, e.type, p.language from s_events e join s_players p on p.id = e.player_id "
    "and e.occurred_at < p.registered_at"
)

PAGE_SQL = (
    PLAYERS + "select p.id, u.email, strftime(p.registered_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' as registered_at, "
    "p.total_score, p.language from s_players p left join s_users u on u.id = p.user_id where p.version_id = 1 "
)


def _iso(frame: DataFrame) -> DataFrame:
    # The stand-in timestamps carry no zone; give them the UTC one that stored tables have.
    return frame.withColumn("registered_at", F.col("registered_at").cast("timestamp"))


QUERIES["players_page"] = lambda spark, sf: player_page(
    _iso(st.table(spark, sf, "players")), st.table(spark, sf, "users"), 1, page=3, per_page=100
)
ORACLES["players_page"] = PAGE_SQL + "order by p.id limit 100 offset 200"
QUERIES["players_keyset_page"] = lambda spark, sf: player_keyset_page(
    _iso(st.table(spark, sf, "players")), st.table(spark, sf, "users"), 1, after_id=40, per_page=75
)
ORACLES["players_keyset_page"] = PAGE_SQL + "and p.id > 40 order by p.id limit 75"
QUERIES["players_public_view"] = lambda spark, sf: player_listing(
    _iso(st.table(spark, sf, "players")), st.table(spark, sf, "users"), None
)
ORACLES["players_public_view"] = PAGE_SQL.replace("select p.id", "select p.version_id, p.id").replace(
    "where p.version_id = 1", ""
)

ANSWERS = ctes("answers")
add_sheet(
    "answers_sheet",
    {"name": "answers", "sort": ["occurred_at:desc"]},
    ANSWERS + "select version_id, id, player_id, question_id, answer_option_id, answer_text, occurred_at "
    "from s_answers where occurred_at >= timestamp '2024-01-10'",
    date_from="2024-01-10",
)
add_sheet(
    "answers_counts",
    {
        "source": "answers", "group_by": ["question_id"],
        "columns": ["question_id", {"fn": "count", "as": "n"}, {"fn": "count_distinct", "field": "player_id"},
                    {"fn": "count_distinct", "field": "answer_option_id"}],
        "filters": {"question_id": [0, 1, 3], "occurred_to": "2024-02-15"},
    },
    ANSWERS + "select version_id, question_id, count(*) as n, count(distinct player_id) as count_distinct_player_id, "
    "count(distinct answer_option_id) as count_distinct_answer_option_id from s_answers "
    "where question_id in (0, 1, 3) and occurred_at <= timestamp '2024-02-15' group by 1, 2",
)

TRANSACTIONS = ctes("transactions")
add_sheet(
    "transactions_sheet",
    {"name": "transactions", "filters": {"status": "completed", "type": ["purchase", "refund"]},
     "columns": ["id", "player_id", "type", "amount", "currency", "status", "external_ref", "occurred_at"],
     "sort": ["amount:desc"]},
    TRANSACTIONS + "select version_id, id, player_id, type, cast(amount as double) as amount, currency, status, "
    "external_ref, occurred_at from s_transactions where status = 'completed' and type in ('purchase', 'refund')",
    doubles=("amount",),
)
AMOUNTS = [
    "type", "currency", {"fn": "count"}, {"fn": "sum", "field": "amount"}, {"fn": "avg", "field": "amount"},
    {"fn": "min", "field": "amount"}, {"fn": "max", "field": "amount"},
]
AMOUNTS_SQL = (
    "count(*) as count_all, {sum} as sum_amount, "
    + money_avg2("sum(cast(amount * 100 as bigint))", "count(amount)")
    + " as avg_amount, cast(min(amount) as double) as min_amount, cast(max(amount) as double) as max_amount "
    "from s_transactions group by 1, 2, 3"
)
for _name, _sum, _settings in (
    ("transactions_amounts", "cast(sum(amount) as double)", DEFAULT_SETTINGS),
    ("transactions_amounts_whole", "sum(cast(amount * 100 as bigint)) // 100", Settings(compat_int_sum=True)),
):
    add_sheet(
        _name,
        {"source": "transactions", "columns": AMOUNTS, "group_by": ["type", "currency"]},
        TRANSACTIONS + "select version_id, type, currency, " + AMOUNTS_SQL.format(sum=_sum),
        doubles=("min_amount", "max_amount") + (("sum_amount",) if not _settings.compat_int_sum else ()),
        settings=_settings,
    )


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = DEFAULT_SETTINGS.preview_rows
    params = {"sheets": [{"source": "transactions", "sort": ["amount:desc"]}]}
    shown = preview_frame(run_sheet(spark, sf_dir, params, 1), limit)
    return shown.agg(
        F.least(F.count(F.lit(1)), F.lit(limit)).alias("shown"),
        (F.count(F.lit(1)) > limit).alias("truncated"),
        F.max("amount").cast("double").alias("top_amount"),
    )


QUERIES["preview_truncated"] = _preview
ORACLES["preview_truncated"] = (
    TRANSACTIONS + "select least(count(*), 100) as shown, count(*) > 100 as truncated, "
    "cast(max(amount) as double) as top_amount from s_transactions where version_id = 1"
)



def _preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a preview shows, as it returns them."""
    params = {"sheets": [{"source": "transactions", "columns": ["id", "type", "amount"], "sort": ["amount:desc"]}]}
    [shown] = preview(params, st.tables(spark, sf_dir), 1)
    rows = [(n, *(r[c] for c in ("id", "type", "amount"))) for n, r in enumerate(shown["rows"], start=1)]
    return spark.createDataFrame(rows, "place int, id bigint, type string, amount decimal(12,2)").withColumn("amount", F.col("amount").cast("double"))


QUERIES["preview_rows"] = _preview_rows
ORACLES["preview_rows"] = (
    TRANSACTIONS + "select cast(row_number() over (order by amount desc, id) as int) as place, id, type, cast(amount as double) as amount "
    "from s_transactions where version_id = 1 qualify place <= 100"
)

VERSIONS = ctes("versions")
QUERIES["versions_live"] = lambda spark, sf: live_versions(st.table(spark, sf, "versions")).select(
    "id", "uuid", "name", "status"
)
ORACLES["versions_live"] = VERSIONS + "select id, uuid, name, status from s_versions where deleted_at is null"
QUERIES["versions_with_trashed"] = lambda spark, sf: live_versions(st.table(spark, sf, "versions"), True).select(
    "id", "name", F.col("deleted_at").isNotNull().alias("trashed")
)
ORACLES["versions_with_trashed"] = (
    VERSIONS + "select id, name, deleted_at is not null as trashed from s_versions"
)


def _events_by_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = version_by_uuid(st.table(spark, sf_dir, "versions"), "nation_2").first()["id"]
    return for_version(st.table(spark, sf_dir, "events"), version).groupBy("type").agg(
        F.count(F.lit(1)).alias("n")
    )


QUERIES["events_by_version_uuid"] = _events_by_uuid
ORACLES["events_by_version_uuid"] = (
    ctes("versions", "events")
    + "select type, count(*) as n from s_events where version_id = (select id from s_versions "
    "where uuid = 'nation_2' and deleted_at is null) group by 1"
)


# A request over all four sources; its dates cut into the stand-ins' time ranges.
WORKBOOK = {
    "date_from": "1996-03-01",
    "date_to": "2024-01-12",
    "sheets": [
        {"name": "Spending", "source": "transactions", "group_by": ["currency", "status"],
         "columns": ["currency", "status", {"fn": "sum", "field": "amount", "as": "total"}, {"fn": "count", "as": "n"}]},
        {"name": "Ranking", "source": "players", "columns": ["player_id", {"field": "total_score", "as": "points"}, "language"],
         "sort": [{"column": "total_score", "direction": "desc"}]},
        {"name": "Clicks", "source": "events", "filters": {"type": ["click"], "language": ["en", "es"]},
         "columns": ["id", "player_id", "score"], "sort": ["score:desc", "id"]},
        {"name": "Replies", "source": "answers", "group_by": ["question_id"], "metrics": ["unique_players", "count"]},
    ],
}
BETWEEN = "occurred_at >= timestamp '1996-03-01' and occurred_at <= timestamp '2024-01-12'"
WORKBOOK_COUNTS = (
    ctes("players", "users", "events", "answers", "transactions")
    + ", counts as ("
    f"select version_id, 1 as sheet_no, 'Spending' as metric, count(distinct (currency, status)) as n from s_transactions where {BETWEEN} group by 1 "
    "union all select version_id, 2, 'Ranking', count(*) from s_players group by 1 "
    f"union all select version_id, 3, 'Clicks', count(*) from s_events where {BETWEEN} and type = 'click' and {E_LANG} in ('en', 'es') group by 1 "
    f"union all select version_id, 4, 'Replies', count(distinct question_id) from s_answers where {BETWEEN} group by 1) "
)
QUERIES["kpis_sheet"] = lambda spark, sf: sheet_counts(WORKBOOK, st.tables(spark, sf), None)
ORACLES["kpis_sheet"] = (
    WORKBOOK_COUNTS + 'select version_id, sheet_no, metric, n as "rows" from counts union all '
    "select version_id, 5, 'Total', sum(n) from counts group by 1"
)


def _sheet_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = parse_spec({"sheets": [{"source": "transactions", "columns": ["id", "type"]}]}).sheets[0]
    return sheet_page(spec, st.tables(spark, sf_dir), 2, after=100, size=1000).drop("_key")


QUERIES["transactions_keyset_page"] = _sheet_page
ORACLES["transactions_keyset_page"] = (
    TRANSACTIONS + "select id, type from s_transactions where version_id = 2 and id > 100 order by id limit 1000"
)
QUERIES["users_by_email_prefix"] = lambda spark, sf: st.table(spark, sf, "users").where(
    has_prefix(F.col("email"), "customer#00000001")
)
ORACLES["users_by_email_prefix"] = (
    ctes("users") + "select id, email, external_id from s_users where email like 'customer#00000001%'"
)
