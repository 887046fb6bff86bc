"""Campaign tables derived from the shared test tables, as Spark frames and as DuckDB CTEs.

The expressions below are plain SQL that both engines read the same way, except for JSON access
and the zone-less timestamp type, which are filled in per engine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from campaignlake.sources.tables import LazyTables

SPARK = {
    "K": "get_json_object(props, '$.k')",
    "TS": "timestamp_ntz",
    "SEC": "date_format(date_trunc('second', {0}), 'yyyy-MM-dd HH:mm:ss')",
}
DUCK = {
    "K": "json_extract_string(props, '$.k')",
    "TS": "timestamp",
    "SEC": "strftime(date_trunc('second', {0}), '%Y-%m-%d %H:%M:%S')",
}
FAR = 1_000_000_000_000


def lang(key: str) -> str:
    return (
        f"case when {key} % 8 < 4 then 'it' when {key} % 8 < 6 then 'en' "
        f"when {key} % 8 = 6 then 'es' else 'fr' end"
    )


def mail(key: str) -> str:
    return f"'customer#' || lpad(cast({key} as string), 9, '0') || '@example.com'"


# name -> (base table, list of "expression as column")
DEFINITIONS: dict[str, tuple[str, list[str]]] = {
    "versions": (
        "nation",
        [
            "cast(n_nationkey as bigint) as id",
            "lower(n_name) as uuid",
            "n_name as name",
            "case when n_nationkey % 3 = 0 then 'draft' when n_nationkey % 3 = 1 then 'active' "
            "else 'archived' end as status",
            "case when n_nationkey % 5 = 4 then cast('2024-01-15 00:00:00' as {TS}) end as deleted_at",
        ],
    ),
    "users": ("customer", ["c_custkey as id", "lower(c_name) || '@example.com' as email",
                           "'x' || cast(c_custkey as string) as external_id"]),
    "players": (
        "customer",
        [
            "c_custkey as id",
            "c_custkey as user_id",
            "c_custkey % 3 as version_id",
            "cast(floor(greatest(c_acctbal, 0)) as int) as total_score",
            f"{lang('c_custkey')} as language",
            "case when c_custkey % 50 = 0 then null else cast(TIMESTAMP '2024-01-01 00:00:00' as {TS}) "
            "+ INTERVAL '1' DAY * cast(c_custkey * 7 % 30 as int) end as registered_at",
        ],
    ),
    "events": (
        "events",
        [
            "event_id as id",
            "user_id as player_id",
            "user_id % 3 as version_id",
            "ts as occurred_at",
            "event_type as type",
            "case when event_id % 53 = 0 then '[]' "
            "when event_id % 37 = 0 then '{{\"score\": ' || {K} || '}}' "
            f"else '{{{{\"language\": \"' || {lang('user_id')} || '\", \"utm_source\": \"' || "
            "case event_id % 5 when 0 then 'linkedin' when 1 then 'facebook' when 2 then 'google' "
            "when 3 then 'newsletter' else 'direct' end || '\", \"score\": ' || {K} || '}}' end as payload",
        ],
    ),
    "questions": (
        "region",
        ["cast(r_regionkey as bigint) as id", "cast(r_regionkey % 3 as bigint) as version_id",
         "r_name as code", "r_name as text"],
    ),
    "answer_options": (
        "nation",
        ["cast(n_nationkey as bigint) as id", "cast(n_regionkey % 3 as bigint) as version_id",
         "cast(n_regionkey as bigint) as question_id", "n_name as label", "n_nationkey as position",
         "case when n_nationkey % 4 = 3 then null else n_nationkey % 2 = 0 end as is_correct"],
    ),
    "transactions": (
        "orders",
        [
            "o_orderkey as id",
            "o_custkey as player_id",
            "o_custkey % 3 as version_id",
            "case when o_orderkey % 3 = 0 then 'purchase' when o_orderkey % 3 = 1 then 'spend' "
            "else 'refund' end as type",
            "cast(o_totalprice as decimal(12,2)) as amount",
            "'EUR' as currency",
            "case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'failed' end as status",
            "case when o_orderkey % 4 = 0 then null else 'ref' || cast(o_orderkey as string) end as external_ref",
            "o_orderdate as occurred_at",
        ],
    ),
}

# One answer per customer: the customer's nation is the chosen option.
ANSWERS = (
    "select c_custkey as id, c_custkey as player_id, c_custkey % 3 as version_id, "
    "cast(n_regionkey as bigint) as question_id, cast(n_nationkey as bigint) as answer_option_id, "
    "case when c_custkey % 6 = 0 then 'free ' || c_name end as answer_text, "
    "cast(TIMESTAMP '2024-01-01 00:00:00' as {TS}) + INTERVAL '1' DAY * cast(c_custkey % 60 as int) as occurred_at "
    "from customer join nation on c_nationkey = n_nationkey"
)

# Event batch: every event, plus a later second copy of the signups.
BATCH_COLUMNS = (
    "user_id % 3 as version_id, "
    f"cast(case when event_id % 13 = 0 then user_id + {FAR} else user_id end as string) as player_id, "
    f"case when event_id % 2 = 0 then {mail('user_id')} end as player_email, "
    "event_type as type, cast(ts as string) as occurred_at, "
    "'{{\"language\": \"' || " + lang("user_id") + " || '\", \"score\": ' || {K} || '}}' as payload, "
    "case when event_id % 7 = 0 then null when event_id % 11 = 0 then '   ' "
    "else 'e' || cast(event_id as string) end as dedup_key"
)
EVENT_BATCH = (
    f"select event_id as ord, {BATCH_COLUMNS} from events "
    f"union all select event_id + {FAR} as ord, {BATCH_COLUMNS} from events where event_type = 'signup'"
)
# Keys stored by an earlier batch: the views.
STORED_KEYS = (
    "select user_id % 3 as version_id, 'e' || cast(event_id as string) as dedup_key "
    "from events where event_type = 'view'"
)

# Typed events: payloads with missing, invalid and oversized values in known places.
TYPED_EVENTS = (
    "select event_id as id, user_id % 3 as version_id, user_id as player_id, {OCC} as occurred_at, "
    "case event_type when 'click' then 'answer_submitted' when 'purchase' then 'transaction' "
    "when 'signup' then 'reward_granted' else event_type end as type, "
    "case event_type "
    "when 'click' then '{{' "
    "|| case when event_id % 9 = 0 then '' else '\"question_id\": ' || cast(event_id % 7 as string) || ', ' end "
    "|| case when event_id % 8 = 0 then '' else '\"answer_option_id\": ' || cast(event_id % 30 as string) || ', ' end "
    "|| case when event_id % 6 = 0 then '\"answer_text\": \"because\", ' else '' end || '\"seen\": true}}' "
    "when 'purchase' then '{{\"type\": \"' || case event_id % 4 when 0 then 'purchase' when 1 then 'spend' "
    "when 2 then 'refund' else 'gift' end || '\", ' "
    "|| case when event_id % 9 = 0 then '' when event_id % 15 = 1 then '\"amount\": \"lots\", ' "
    "when event_id % 15 = 2 then '\"amount\": 12345678901234, ' "
    "else '\"amount\": ' || cast(event_id % 1000 as string) || '.25, ' end "
    "|| case event_id % 5 when 0 then '\"status\": \"pending\", ' when 1 then '\"status\": \"lost\", ' else '' end "
    "|| '\"currency\": \"' || case when event_id % 50 = 4 then 'EURO' else 'EUR' end || '\"}}' "
    "when 'signup' then '{{' || case when event_id % 9 = 0 then '' else '\"reward_type\": \"coupon\", ' end "
    "|| case when event_id % 4 = 0 then '' else '\"reward_code\": \"C' || cast(event_id as string) || '\", ' end "
    "|| '\"seen\": true}}' else '[]' end as payload "
    "from events"
)

# Player batch: every customer, plus a later copy of one segment with another language.
PLAYER_COLUMNS = (
    "c_custkey % 3 as version_id, lower(c_name) || '@example.com' as email, "
    "case when c_custkey % 9 = 0 then null else 'n' || cast(c_custkey as string) end as external_id, "
    "case when c_custkey % 50 = 0 then null else '2024-02-' || lpad(cast(1 + c_custkey % 28 as string), 2, '0') end "
    "as registered_at"
)
PLAYER_BATCH = (
    f"select c_custkey as ord, {PLAYER_COLUMNS}, {lang('c_custkey')} as language from customer "
    f"union all select c_custkey + {FAR} as ord, {PLAYER_COLUMNS}, 'de' as language from customer "
    "where c_mktsegment = 'BUILDING'"
)


def work_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="campaignlake-")
    return f"{root.rstrip('/')}/{uuid.uuid4()}"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _views(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Run SQL over the named test tables without touching the session's temp views."""
    return spark.sql(
        sql.replace("from events", "from {events}").replace("from customer", "from {customer}").replace(
            "join nation", "join {nation}"
        ),
        **{name: load(spark, sf_dir, name) for name in names},
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "answers":
        return _views(spark, sf_dir, ANSWERS.format(**SPARK), "customer", "nation")
    base, columns = DEFINITIONS[name]
    return load(spark, sf_dir, base).selectExpr(*[c.format(**SPARK) for c in columns])


def tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    return LazyTables([*DEFINITIONS, "answers"], lambda name: table(spark, sf_dir, name))


def event_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    first = events.selectExpr("*", "event_id as ord")
    again = events.where("event_type = 'signup'").selectExpr("*", f"event_id + {FAR} as ord")
    return spark.sql(
        "select ord, " + BATCH_COLUMNS.format(**SPARK).replace("{", "{{").replace("}", "}}") + " from {batch}",
        batch=first.unionByName(again),
    )


def stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, STORED_KEYS, "events")


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = TYPED_EVENTS.format(OCC=SPARK["SEC"].format("ts"), **SPARK)
    columns = sql.removeprefix("select ").removesuffix(" from events")
    return spark.sql(
        "select " + columns.replace("{", "{{").replace("}", "}}") + ", cast(null as timestamp) as created_at from {events}",
        events=load(spark, sf_dir, "events"),
    )


def player_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = load(spark, sf_dir, "customer")
    first = customer.selectExpr("*", "c_custkey as ord", f"{lang('c_custkey')} as language")
    again = customer.where("c_mktsegment = 'BUILDING'").selectExpr("*", f"c_custkey + {FAR} as ord", "'de' as language")
    return spark.sql("select ord, " + PLAYER_COLUMNS + ", language from {batch}", batch=first.unionByName(again))


def ctes(*names: str) -> str:
    """`with …` prefix for DuckDB defining the named stand-ins."""
    texts = {
        "answers": ANSWERS,
        "event_batch": EVENT_BATCH,
        "stored_keys": STORED_KEYS,
        "typed_events": TYPED_EVENTS,
        "player_batch": PLAYER_BATCH,
    }
    fill = {**DUCK, "OCC": DUCK["SEC"].format("ts")}
    parts = []
    for name in names:
        if name in DEFINITIONS:
            base, columns = DEFINITIONS[name]
            sql = f"select {', '.join(columns)} from {base}"
        else:
            sql = texts[name]
        parts.append(f"s_{name} as ({sql.format(**fill)})")
    return "with " + ", ".join(parts) + " "
