"""Ingestion queries: resolution, dedup, merge, typed projection and row rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlake.functions.normalize import to_utc
from campaignlake.ingest import jobs
from campaignlake.operators.dedup import new_by_natural_key, new_rows
from campaignlake.operators.merge import (
    collapse_players,
    collapse_users,
    external_id_clashes,
    merge_players,
    merge_users,
    player_counters,
)
from campaignlake.operators.resolve import count_unresolved, resolve_players
from campaignlake.operators.typed import project_typed, skipped_records, typed_records
from campaignlake.operators.validate import with_errors
from suite import standins as st
from suite.sheets import Query
from suite.standins import DUCK, FAR, ctes, mail

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FIRST_ID = 5000
NOW = datetime(2024, 3, 1)


def _text_time(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def _identities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return st.table(spark, sf_dir, "players"), st.table(spark, sf_dir, "users")


# --- events ---------------------------------------------------------------------------------------

KNOWN = (
    ctes("event_batch", "stored_keys", "players", "users")
    + ", mails as (select p.version_id, p.id, u.email from s_players p join s_users u on u.id = p.user_id), "
    "resolved as (select b.*, nullif(trim(b.dedup_key), '') as k, coalesce(p.id, m.id) as pid from s_event_batch b "
    "left join s_players p on p.id = cast(b.player_id as bigint) and p.version_id = b.version_id "
    "left join mails m on m.email = b.player_email and m.version_id = b.version_id), "
    "ranked as (select *, row_number() over (partition by version_id, k order by ord) as rn from resolved "
    "where pid is not null), "
    "fresh as (select * from ranked r where k is null or (rn = 1 and not exists "
    "(select 1 from s_stored_keys s where s.version_id = r.version_id and s.dedup_key = r.k))) "
)


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = jobs.event_candidates(st.event_batch(spark, sf_dir))
    return resolve_players(candidates, *_identities(spark, sf_dir)).select("ord", "version_id", "resolved_id")


QUERIES["resolve_players"] = _resolved
ORACLES["resolve_players"] = KNOWN + "select ord, version_id, pid as resolved_id from resolved"


def _new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = jobs.event_candidates(st.event_batch(spark, sf_dir))
    known = jobs.resolved_rows(candidates, *_identities(spark, sf_dir))
    return jobs.stored_events(new_rows(known, st.stored_keys(spark, sf_dir), wanted=candidates), FIRST_ID)


QUERIES["ingest_events_new"] = lambda spark, sf: _text_time(_new_events(spark, sf), "occurred_at").select(
    "id", "version_id", "player_id", "type", "occurred_at", "payload", "dedup_key"
)
ORACLES["ingest_events_new"] = (
    KNOWN + f"select {FIRST_ID} + ord as id, version_id, pid as player_id, type, "
    f"{DUCK['SEC'].format('cast(occurred_at as timestamp)')} as occurred_at, "
    "payload, k as dedup_key from fresh"
)


def _event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = jobs.event_candidates(st.event_batch(spark, sf_dir))
    seen = count_unresolved(candidates, *_identities(spark, sf_dir)).select(
        F.struct("rows", "failed").alias("seen"), F.lit(None).cast("bigint").alias("inserted")
    )
    added = _new_events(spark, sf_dir).agg(F.count(F.lit(1)).alias("inserted"))
    both = seen.unionByName(added, allowMissingColumns=True).agg(
        F.max("seen").alias("seen"), F.max("inserted").alias("inserted")
    )
    return both.select(
        F.col("seen.rows").alias("processed"),
        "inserted",
        (F.col("seen.rows") - F.col("seen.failed") - F.col("inserted")).alias("duplicates"),
        F.col("seen.failed").alias("failed"),
    )


QUERIES["ingest_events_counters"] = _event_counters
ORACLES["ingest_events_counters"] = (
    KNOWN + "select (select count(*) from resolved) as processed, (select count(*) from fresh) as inserted, "
    "(select count(*) from ranked) - (select count(*) from fresh) as duplicates, "
    "(select count(*) from resolved where pid is null) as failed"
)

# --- players --------------------------------------------------------------------------------------

EXISTING = "c_mktsegment = 'MACHINERY'"


def _existing_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.load(spark, sf_dir, "customer").where(EXISTING).selectExpr(
        "c_custkey as id", "lower(c_name) || '@example.com' as email",
        "'x' || cast(c_custkey as string) as external_id",
        "cast(null as timestamp) as created_at", "cast(null as timestamp) as updated_at",
    )


def _existing_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = st.table(spark, sf_dir, "players")
    kept = _existing_users(spark, sf_dir).select("id")
    return players.join(kept, "id", "left_semi").selectExpr(
        "id", "version_id", "user_id", "cast(registered_at as timestamp) as registered_at", "total_score",
        "language", "cast(null as timestamp) as created_at", "cast(null as timestamp) as updated_at",
    )


def _merged_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = st.player_batch(spark, sf_dir)
    return merge_users(_existing_users(spark, sf_dir), collapse_users(batch), FIRST_ID, F.lit(NOW))


def _merged_players(spark: SparkSession, sf_dir: str, chunk_size: int | None = None) -> DataFrame:
    batch = st.player_batch(spark, sf_dir).withColumn("registered_at", to_utc(F.col("registered_at")))
    mails = st.table(spark, sf_dir, "users").selectExpr("id as user_id", "email")
    collapsed = collapse_players(batch, chunk_size).join(mails, "email")
    return merge_players(_existing_players(spark, sf_dir), collapsed, FIRST_ID, F.lit(NOW))


PLAYER_SQL = (
    ctes("player_batch", "users", "players")
    + f", e_users as (select u.* from s_users u join customer on c_custkey = u.id where {EXISTING}), "
    f"e_players as (select p.* from s_players p join customer on c_custkey = p.id where {EXISTING}), "
    "last as (select * from (select *, row_number() over (partition by version_id, email order by ord desc) as rn "
    "from s_player_batch) where rn = 1), "
)
QUERIES["ingest_users_merge"] = lambda spark, sf: _merged_users(spark, sf).select("id", "email", "external_id")
ORACLES["ingest_users_merge"] = (
    PLAYER_SQL
    + f"m as (select coalesce(e.id, {FIRST_ID} + l.ord) as id, coalesce(e.email, l.email) as email, "
    "case when l.email is not null then l.external_id else e.external_id end as external_id "
    "from e_users e full join last l on l.email = e.email) select * from m"
)
QUERIES["ingest_players_merge"] = lambda spark, sf: _text_time(_merged_players(spark, sf), "registered_at").select(
    "id", "version_id", "user_id", "registered_at", "total_score", "language"
)
ORACLES["ingest_players_merge"] = (
    PLAYER_SQL
    + "b as (select l.*, u.id as user_id from last l join s_users u on u.email = l.email), "
    f"m as (select coalesce(e.id, {FIRST_ID} + b.ord) as id, coalesce(e.version_id, b.version_id) as version_id, "
    "coalesce(e.user_id, b.user_id) as user_id, "
    f"{DUCK['SEC'].format('case when b.ord is not null then cast(b.registered_at as timestamp) else e.registered_at end')} "
    "as registered_at, coalesce(e.total_score, 0) as total_score, "
    "case when b.ord is not null then b.language else e.language end as language "
    "from e_players e full join b on b.user_id = e.user_id and b.version_id = e.version_id) select * from m"
)
QUERIES["ingest_players_counters"] = lambda spark, sf: player_counters(_merged_players(spark, sf, 1000))
ORACLES["ingest_players_counters"] = (
    PLAYER_SQL
    + "touch as (select distinct version_id, email, ord // 1000 as chunk from s_player_batch), "
    "added as (select version_id, email from last l where not exists "
    "(select 1 from e_users e where e.email = l.email)) "
    "select (select count(*) from added) as inserted, "
    "(select count(*) from touch) - (select count(*) from added) as duplicates"
)


def _clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch row claims the external id of the customer with the next number."""
    batch = st.player_batch(spark, sf_dir).selectExpr(
        "email", "ord", f"'x' || cast((ord % {FAR}) + 1 as string) as external_id"
    )
    return external_id_clashes(batch, _existing_users(spark, sf_dir))


QUERIES["external_id_clashes"] = _clashes
ORACLES["external_id_clashes"] = (
    PLAYER_SQL
    + f"asked as (select distinct email, 'x' || cast((ord % {FAR}) + 1 as string) as external_id from s_player_batch) "
    "select distinct a.email from asked a join e_users e on e.external_id = a.external_id where e.email <> a.email"
)

# --- direct facts -----------------------------------------------------------------------------------

FACT = {
    "ord": "o_orderkey as ord",
    "version_id": "o_custkey % 3 as version_id",
    "player_id": f"cast(case when o_orderkey % 13 = 0 then o_custkey + {FAR} else o_custkey end as string) as player_id",
    "player_email": f"case when o_orderkey % 2 = 0 then {mail('o_custkey')} end as player_email",
    "dedup_key": "case when o_orderkey % 7 = 0 then '  ' else 'd' || cast(o_custkey * 100 + o_orderkey % 10 as string) "
    "end as dedup_key",
    "when": "cast(o_orderdate as string)",
}
TX_COLUMNS = [
    FACT["ord"], FACT["version_id"], FACT["player_id"], FACT["player_email"], FACT["dedup_key"],
    "case when o_orderkey % 3 = 0 then 'purchase' else 'refund' end as type",
    "cast(cast(o_totalprice as decimal(12,2)) as string) as amount", "'EUR' as currency",
    "case when o_orderkey % 5 = 0 then 'pending' end as status",
    "cast(null as string) as external_ref", f"{FACT['when']} as occurred_at",
]
RW_COLUMNS = [
    FACT["ord"], FACT["version_id"], FACT["player_id"], FACT["player_email"], FACT["dedup_key"],
    "o_orderpriority as reward_type", "case when o_orderkey % 4 = 0 then null else 'C1' end as reward_code",
    "case when o_orderstatus = 'F' then 'redeemed' end as status", f"{FACT['when']} as granted_at",
    f"case when o_orderstatus = 'F' then {FACT['when']} end as redeemed_at",
]
AN_COLUMNS = [
    FACT["ord"], FACT["version_id"], FACT["player_id"], FACT["player_email"],
    "cast(o_orderkey % 7 as string) as question_id",
    "case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 30 as string) end as answer_option_id",
    "case when o_orderkey % 4 = 0 then 'because' end as answer_text", f"{FACT['when']} as occurred_at",
]
STORED_FACTS = "select c_custkey % 3 as version_id, 'd' || cast(c_custkey * 100 as string) as dedup_key from customer"


def _facts(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return st.load(spark, sf_dir, "orders").selectExpr(*columns)


def _stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.load(spark, sf_dir, "customer").selectExpr(
        "c_custkey % 3 as version_id", "'d' || cast(c_custkey * 100 as string) as dedup_key"
    )


def _fact_sql(columns: list[str]) -> str:
    return (
        ctes("players", "users", "questions", "answer_options")
        + f", b as (select {', '.join(columns)} from orders), stored as ({STORED_FACTS}), "
        "mails as (select p.version_id, p.id, u.email from s_players p join s_users u on u.id = p.user_id), "
        "known as (select b.*, coalesce(p.id, m.id) as pid from b "
        "left join s_players p on p.id = cast(b.player_id as bigint) and p.version_id = b.version_id "
        "left join mails m on m.email = b.player_email and m.version_id = b.version_id "
        "where coalesce(p.id, m.id) is not null), "
    )


KEYED_SQL = (
    "ranked as (select *, nullif(trim(dedup_key), '') as k, row_number() over "
    "(partition by version_id, nullif(trim(dedup_key), '') order by ord) as rn from known), "
    "fresh as (select * from ranked r where k is null or (rn = 1 and not exists (select 1 from stored s "
    "where s.version_id = r.version_id and s.dedup_key = r.k))) "
)


def _fresh_facts(spark: SparkSession, sf_dir: str, candidates: DataFrame) -> DataFrame:
    known = jobs.resolved_rows(candidates, *_identities(spark, sf_dir))
    return jobs.with_ids(new_rows(known, _stored_facts(spark, sf_dir), wanted=candidates), FIRST_ID)


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = _fresh_facts(spark, sf_dir, jobs.transaction_candidates(_facts(spark, sf_dir, TX_COLUMNS)))
    return _text_time(fresh, "occurred_at").select(
        "id", "version_id", "player_id", "type", F.col("amount").cast("double").alias("amount"), "currency",
        "status", "dedup_key", "occurred_at",
    )


QUERIES["ingest_transactions"] = _transactions
ORACLES["ingest_transactions"] = (
    _fact_sql(TX_COLUMNS) + KEYED_SQL
    + f"select {FIRST_ID} + ord as id, version_id, pid as player_id, type, cast(amount as double) as amount, currency, "
    "coalesce(status, 'completed') as status, k as dedup_key, "
    f"{DUCK['SEC'].format('cast(occurred_at as timestamp)')} as occurred_at from fresh"
)


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = _fresh_facts(spark, sf_dir, jobs.reward_candidates(_facts(spark, sf_dir, RW_COLUMNS)))
    return _text_time(fresh, "granted_at", "redeemed_at").select(
        "id", "version_id", "player_id", "reward_type", "reward_code", "status", "granted_at", "redeemed_at",
        "dedup_key",
    )


QUERIES["ingest_rewards"] = _rewards
ORACLES["ingest_rewards"] = (
    _fact_sql(RW_COLUMNS) + KEYED_SQL
    + f"select {FIRST_ID} + ord as id, version_id, pid as player_id, reward_type, reward_code, "
    "coalesce(status, 'granted') as status, "
    f"{DUCK['SEC'].format('cast(granted_at as timestamp)')} as granted_at, "
    f"{DUCK['SEC'].format('cast(redeemed_at as timestamp)')} as redeemed_at, k as dedup_key from fresh"
)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = jobs.answer_candidates(_facts(spark, sf_dir, AN_COLUMNS))
    known = jobs.known_answers(
        jobs.resolved_rows(candidates, *_identities(spark, sf_dir)),
        st.table(spark, sf_dir, "questions"),
        st.table(spark, sf_dir, "answer_options"),
    )
    # Answers of the stand-in table are the ones already stored.
    fresh = new_by_natural_key(known, st.table(spark, sf_dir, "answers"), ["version_id", "player_id", "question_id"])
    return _text_time(jobs.with_ids(fresh, FIRST_ID), "occurred_at").select(
        "id", "version_id", "player_id", "question_id", "answer_option_id", "answer_text", "occurred_at"
    )


QUERIES["ingest_answers"] = _answers
ORACLES["ingest_answers"] = (
    _fact_sql(AN_COLUMNS).replace("with ", ctes("answers").rstrip() + ", ", 1)
    + "refs as (select k.* from known k where exists (select 1 from s_questions q where q.version_id = k.version_id "
    "and q.id = cast(k.question_id as bigint)) and (k.answer_option_id is null or exists (select 1 from "
    "s_answer_options o where o.version_id = k.version_id and o.id = cast(k.answer_option_id as bigint)))), "
    "ranked as (select *, row_number() over (partition by version_id, pid, question_id order by ord) as rn from refs) "
    f"select {FIRST_ID} + ord as id, version_id, pid as player_id, cast(question_id as bigint) as question_id, "
    "cast(answer_option_id as bigint) as answer_option_id, answer_text, "
    f"{DUCK['SEC'].format('cast(occurred_at as timestamp)')} as occurred_at from ranked r where rn = 1 and not exists "
    "(select 1 from s_answers a where a.version_id = r.version_id and a.player_id = r.pid and "
    "a.question_id = cast(r.question_id as bigint))"
)

# --- typed projection -------------------------------------------------------------------------------


def value(key: str) -> str:
    return f"nullif(json_extract_string(payload, '$.{key}'), '')"


TYPED_SQL = (
    ctes("typed_events", "questions", "answer_options")
    + ", a as (select e.*, "
    f"case when {value('question_id')} is null then 'missing field ''question_id''' "
    f"when not exists (select 1 from s_questions q where q.version_id = e.version_id and "
    f"q.id = try_cast({value('question_id')} as bigint)) then 'unknown question ''' || {value('question_id')} || '''' "
    f"when {value('answer_option_id')} is not null and not exists (select 1 from s_answer_options o where "
    f"o.version_id = e.version_id and o.id = try_cast({value('answer_option_id')} as bigint)) "
    f"then 'unknown answer_option ''' || {value('answer_option_id')} || '''' "
    f"when {value('answer_option_id')} is null and {value('answer_text')} is null then 'require_any not satisfied' "
    "end as reason from s_typed_events e where type = 'answer_submitted'), "
    "t as (select e.*, "
    f"case when {value('type')} not in ('purchase', 'spend', 'refund') then 'invalid value for ''type''' "
    f"when {value('amount')} is null then 'missing field ''amount''' "
    f"when not regexp_full_match({value('amount')}, '[0-9]+(\\.[0-9]+)?') then 'non-numeric ''amount''' "
    f"when {value('status')} not in ('pending', 'completed', 'failed') then 'invalid value for ''status''' "
    f"when try_cast({value('amount')} as decimal(12,2)) is null then 'out of range ''amount''' "
    f"when length({value('currency')}) > 3 then 'too long ''currency''' "
    "end as reason from s_typed_events e where type = 'transaction'), "
    f"r as (select e.*, case when {value('reward_type')} is null then 'missing field ''reward_type''' end as reason "
    "from s_typed_events e where type = 'reward_granted') "
)


def _project(event_type: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return project_typed(st.typed_events(spark, sf_dir), event_type, st.tables(spark, sf_dir))

    return run


def _typed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = typed_records(_project("answer_submitted")(spark, sf_dir)).withColumn("ord", F.col("event_id"))
    stored = st.table(spark, sf_dir, "answers")
    return new_by_natural_key(records, stored, ["version_id", "player_id", "question_id"]).select(
        "version_id", "player_id", "event_id", "question_id", "answer_option_id", "answer_text", "occurred_at"
    )


QUERIES["typed_answers"] = _typed_answers
ORACLES["typed_answers"] = (
    TYPED_SQL.replace("with ", ctes("answers").rstrip() + ", ", 1)
    + f", ok as (select *, cast({value('question_id')} as bigint) as q from a where reason is null), "
    "ranked as (select *, row_number() over (partition by version_id, player_id, q order by id) as rn from ok) "
    "select version_id, player_id, id as event_id, q as question_id, "
    f"cast({value('answer_option_id')} as bigint) as answer_option_id, {value('answer_text')} as answer_text, occurred_at "
    "from ranked r where rn = 1 and not exists (select 1 from s_answers s where s.version_id = r.version_id "
    "and s.player_id = r.player_id and s.question_id = r.q)"
)
QUERIES["typed_transactions"] = lambda spark, sf: typed_records(_project("transaction")(spark, sf)).select(
    "version_id", "player_id", "event_id", "type", F.col("amount").cast("double").alias("amount"), "currency",
    "status", "occurred_at",
)
ORACLES["typed_transactions"] = (
    TYPED_SQL + f"select version_id, player_id, id as event_id, {value('type')} as type, "
    f"cast(cast({value('amount')} as decimal(12,2)) as double) as amount, {value('currency')} as currency, "
    f"coalesce({value('status')}, 'completed') as status, occurred_at from t where reason is null"
)
QUERIES["typed_rewards"] = lambda spark, sf: typed_records(_project("reward_granted")(spark, sf)).select(
    "version_id", "player_id", "event_id", "reward_type", "reward_code", "status", "granted_at"
)
ORACLES["typed_rewards"] = (
    TYPED_SQL + f"select version_id, player_id, id as event_id, {value('reward_type')} as reward_type, "
    f"{value('reward_code')} as reward_code, 'granted' as status, occurred_at as granted_at from r where reason is null"
)


def _skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [skipped_records(_project(t)(spark, sf_dir)) for t in ("answer_submitted", "transaction", "reward_granted")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES["typed_skipped"] = _skipped
ORACLES["typed_skipped"] = TYPED_SQL + " union all ".join(
    f"select version_id, id as event_id, type, reason from {part} where reason is not null" for part in ("a", "t", "r")
)

# --- row rules ----------------------------------------------------------------------------------------

LONG = "'{0}' || repeat('x', {1})"
# batch type -> (base table, ordinal, text columns; one rule is broken per `ordinal % 20` bucket)
CHECKED: dict[str, tuple[str, str, list[str]]] = {
    "players": (
        "customer",
        "c_custkey",
        [
            "case c_custkey % 20 when 1 then null when 2 then 'no-at-sign' when 3 then '  ' "
            "else lower(c_name) || '@example.com' end as email",
            "case c_custkey % 20 when 4 then repeat('x', 101) else 'n' || cast(c_custkey as string) end as external_id",
            "case c_custkey % 20 when 5 then 'soon' when 6 then null else '2024-02-03 10:00:00' end as registered_at",
            "case c_custkey % 20 when 7 then 'italian-it' else 'it' end as language",
        ],
    ),
    "events": (
        "events",
        "event_id",
        [
            "case event_id % 20 when 1 then repeat('k', 65) else 'e' || cast(event_id as string) end as dedup_key",
            "case event_id % 20 when 2 then null when 3 then 'abc' when 4 then '1.5' else cast(user_id as string) end "
            "as player_id",
            "case event_id % 20 when 5 then 'a b@example.com' when 6 then 'a@example.com' end as player_email",
            "case event_id % 20 when 7 then '' when 8 then repeat('t', 41) else event_type end as type",
            "case event_id % 20 when 9 then null when 10 then 'not a date' else '2024-01-15T10:00:00+02:00' end "
            "as occurred_at",
            "case event_id % 20 when 11 then 'text' when 12 then '[]' when 13 then null else props end as payload",
        ],
    ),
    "transactions": (
        "orders",
        "o_orderkey",
        [
            "case o_orderkey % 20 when 1 then repeat('k', 65) end as dedup_key",
            "case o_orderkey % 20 when 2 then null else cast(o_custkey as string) end as player_id",
            "cast(null as string) as player_email",
            "case o_orderkey % 20 when 3 then 'gift' when 4 then null else 'spend' end as type",
            "case o_orderkey % 20 when 5 then 'lots' when 6 then '1e3' when 7 then null "
            "else cast(cast(o_totalprice as decimal(12,2)) as string) end as amount",
            "case o_orderkey % 20 when 8 then 'EURO' when 9 then 'EU' else 'EUR' end as currency",
            "case o_orderkey % 20 when 10 then 'lost' when 11 then null else 'pending' end as status",
            "case o_orderkey % 20 when 12 then repeat('r', 101) end as external_ref",
            "case o_orderkey % 20 when 13 then '2024-13-45' else cast(o_orderdate as string) end as occurred_at",
        ],
    ),
    "answers": (
        "orders",
        "o_orderkey",
        [
            "case o_orderkey % 20 when 1 then 'x' else cast(o_custkey as string) end as player_id",
            "case o_orderkey % 20 when 2 then '@example.com' end as player_email",
            "case o_orderkey % 20 when 3 then null else '4' end as question_id",
            "case o_orderkey % 20 when 4 then 'b' when 5 then null when 6 then '0' when 7 then null else '12' end "
            "as answer_option_id",
            "case o_orderkey % 20 when 7 then 'why not' when 8 then repeat('a', 501) end as answer_text",
            "case o_orderkey % 20 when 9 then '' else cast(o_orderdate as string) end as occurred_at",
        ],
    ),
    "rewards": (
        "orders",
        "o_orderkey",
        [
            "case o_orderkey % 20 when 1 then repeat('k', 65) end as dedup_key",
            "case o_orderkey % 20 when 2 then null else cast(o_custkey as string) end as player_id",
            "cast(null as string) as player_email",
            "case o_orderkey % 20 when 3 then null when 4 then repeat('t', 41) else 'badge' end as reward_type",
            "case o_orderkey % 20 when 5 then repeat('c', 101) end as reward_code",
            "case o_orderkey % 20 when 6 then 'given' when 7 then 'expired' end as status",
            "case o_orderkey % 20 when 8 then null when 9 then 'x' else cast(o_orderdate as string) end as granted_at",
            "case o_orderkey % 20 when 10 then 'later' when 11 then '2024-02-02' end as redeemed_at",
        ],
    ),
    "versions": (
        "customer",
        "c_custkey",
        [
            "case c_custkey % 20 when 1 then null when 2 then repeat('n', 151) else c_name end as name",
            "case c_custkey % 20 when 3 then repeat('c', 151) end as client_name",
            "case c_custkey % 20 when 4 then 'deleted' when 5 then 'active' end as status",
            "case c_custkey % 20 when 6 then 'x' else '2024-01-10' end as starts_at",
            "case c_custkey % 20 when 7 then '2024-01-09' when 8 then '2024-01-10' end as ends_at",
            "case c_custkey % 20 when 9 then '3' when 10 then '{\"a\": 1}' end as config",
        ],
    ),
}
DATE_SQL = "(regexp_full_match({c}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}([T ].*)?') and try_cast({c} as timestamptz) is not null)"
EMAIL_SQL = "regexp_full_match({c}, '[^@\\s]+@[^@\\s.]+(\\.[^@\\s.]+)*')"
INT_SQL = "regexp_full_match({c}, '\\s*[+-]?\\d+\\s*')"
NUM_SQL = "regexp_full_match({c}, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?')"
JSON_SQL = "(left({c}, 1) in ('{{', '['))"
ROW_SQL: dict[str, list[tuple[str, str, str]]] = {
    "players": [("email", "required", ""), ("email", "email", EMAIL_SQL), ("external_id", "max:100", ""),
                ("registered_at", "date", DATE_SQL), ("language", "max:8", "")],
    "events": [("dedup_key", "max:64", ""), ("player_id", "required", ""), ("player_id", "integer", INT_SQL),
               ("player_email", "email", EMAIL_SQL), ("type", "required", ""), ("type", "max:40", ""),
               ("occurred_at", "required", ""), ("occurred_at", "date", DATE_SQL), ("payload", "array", JSON_SQL)],
    "transactions": [("dedup_key", "max:64", ""), ("player_id", "required", ""), ("type", "required", ""),
                     ("type", "in", "{c} in ('purchase', 'spend', 'refund')"), ("amount", "required", ""),
                     ("amount", "numeric", NUM_SQL), ("currency", "size:3", "length({c}) = 3"),
                     ("status", "in", "{c} in ('pending', 'completed', 'failed')"), ("external_ref", "max:100", ""),
                     ("occurred_at", "date", DATE_SQL)],
    "answers": [("player_id", "integer", INT_SQL), ("player_email", "email", EMAIL_SQL),
                ("question_id", "required", ""), ("answer_option_id", "integer", INT_SQL),
                ("answer_text", "max:500", ""), ("occurred_at", "required", ""),
                ("answer_option_id", "required_without:answer_text",
                 "not (coalesce(answer_option_id in ('', '0'), true) and coalesce(answer_text in ('', '0'), true))")],
    "rewards": [("dedup_key", "max:64", ""), ("player_id", "required", ""), ("reward_type", "required", ""),
                ("reward_type", "max:40", ""), ("reward_code", "max:100", ""),
                ("status", "in", "{c} in ('granted', 'redeemed', 'expired')"), ("granted_at", "required", ""),
                ("granted_at", "date", DATE_SQL), ("redeemed_at", "date", DATE_SQL)],
    "versions": [("name", "required", ""), ("name", "max:150", ""), ("client_name", "max:150", ""),
                 ("status", "in", "{c} in ('draft', 'active', 'archived')"), ("starts_at", "date", DATE_SQL),
                 ("ends_at", "after_or_equal:starts_at",
                  "not (try_cast(ends_at as timestamp) < try_cast(starts_at as timestamp))"),
                 ("config", "array", JSON_SQL)],
}


def _row_rule_sql(field: str, rule: str, ok: str) -> str:
    if rule == "required":
        bad = f"coalesce(trim({field}), '') = ''"
    elif rule.startswith("required_without"):
        bad = f"not ({ok})"
    elif rule.startswith("max:"):
        bad = f"length({field}) > {rule.removeprefix('max:')}"
    else:
        bad = f"coalesce(trim({field}), '') <> '' and not {ok.format(c=field)}"
    return f"select ord, '{field}' as field, '{rule}' as rule from b where {bad}"


def _validate(batch_type: str) -> Query:
    base, ordinal, columns = CHECKED[batch_type]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = st.load(spark, sf_dir, base).selectExpr(f"{ordinal} as ord", *columns)
        return with_errors(rows, batch_type).select("ord", F.inline("errors"))

    return run


for _type, (_base, _ordinal, _columns) in CHECKED.items():
    QUERIES[f"validate_{_type}"] = _validate(_type)
    ORACLES[f"validate_{_type}"] = (
        f"with b as (select {_ordinal} as ord, {', '.join(_columns)} from {_base}) "
        + " union all ".join(_row_rule_sql(*r) for r in ROW_SQL[_type])
    )
