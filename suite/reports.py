"""Data quality, integrity, scores and answer distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campaignlake.operators.distribution import answer_correctness, answer_distribution
from campaignlake.operators.integrity import integrity_report, orphan_counts, version_mismatches
from campaignlake.operators.quality import quality_counts, quality_report
from campaignlake.operators.scores import average_per_player, refresh_total_scores, score_mismatches, score_rollup
from suite import standins as st
from suite.sheets import E_LANG, E_SCORE, Query
from suite.standins import ctes

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GAME = "view"

DQ_SQL = (
    ctes("events", "players")
    + ", flags as (select e.version_id, "
    f"{E_LANG} is null as no_language, payload in ('[]', '{{}}') as empty, "
    "coalesce(e.occurred_at < p.registered_at, false) as early "
    "from s_events e left join s_players p on p.id = e.player_id and p.version_id = e.version_id) "
)
QUERIES["dq_counts"] = lambda spark, sf: quality_counts(
    st.table(spark, sf, "events"), st.table(spark, sf, "players")
)
ORACLES["dq_counts"] = (
    DQ_SQL + "select version_id, count(*) filter (no_language) as missing_language, "
    "count(*) filter (empty) as empty_payload, count(*) filter (early) as invalid_event_order from flags group by 1"
)
QUERIES["dq_checks"] = lambda spark, sf: quality_report(
    st.table(spark, sf, "events"), st.table(spark, sf, "players")
)
ORACLES["dq_checks"] = " union all ".join(
    f"select version_id, '{check}' as \"check\", '{severity}' as severity, count(*) filter ({flag}) as occurrences, "
    f"'{text}' as description from flags group by 1"
    for check, severity, flag, text in (
        ("missing_language", "warning", "no_language", "Eventi senza payload.language."),
        ("empty_payload", "info", "empty", "Eventi con payload JSON vuoto."),
        ("invalid_event_order", "error", "early", "Eventi avvenuti prima della registrazione del player."),
    )
)
ORACLES["dq_checks"] = DQ_SQL + ORACLES["dq_checks"]


def _buyers_without_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions whose player never shows up in the event log."""
    parents = st.table(spark, sf_dir, "events").selectExpr("player_id as id")
    return orphan_counts(st.table(spark, sf_dir, "transactions"), "player_id", parents)


QUERIES["orphan_transactions"] = _buyers_without_events
ORACLES["orphan_transactions"] = (
    ctes("transactions", "events")
    + 'select version_id, player_id, count(*) as "rows" from s_transactions t '
    "where not exists (select 1 from s_events e where e.player_id = t.player_id) group by 1, 2"
)
# The stand-ins have a parent for every child, so some parents are taken away first.
QUERIES["orphan_events"] = lambda spark, sf: orphan_counts(
    st.table(spark, sf, "events"), "player_id", st.table(spark, sf, "players").where("id % 5 <> 0")
).groupBy("version_id").agg(F.sum("rows").alias("rows"))
ORACLES["orphan_events"] = (
    ctes("events", "players")
    + 'select version_id, count(*) as "rows" from s_events e '
    "where not exists (select 1 from s_players p where p.id = e.player_id and p.id % 5 <> 0) group by 1"
)
QUERIES["version_mismatches"] = lambda spark, sf: version_mismatches(
    st.table(spark, sf, "answers"), "question_id", st.table(spark, sf, "questions")
)
ORACLES["version_mismatches"] = (
    ctes("answers", "questions")
    + 'select a.version_id, q.version_id as parent_version_id, count(*) as "rows" from s_answers a '
    "join s_questions q on q.id = a.question_id where a.version_id <> q.version_id group by 1, 2"
)


def _integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity_report(st.tables(spark, sf_dir))


QUERIES["integrity_report"] = _integrity
STAND_IN_RELATIONS = (
    ("players", "user_id", "users"),
    ("players", "version_id", "versions"),
    ("events", "player_id", "players"),
    ("events", "version_id", "versions"),
    ("questions", "version_id", "versions"),
    ("answer_options", "question_id", "questions"),
    ("answers", "version_id", "versions"),
    ("answers", "player_id", "players"),
    ("answers", "question_id", "questions"),
    ("answers", "answer_option_id", "answer_options"),
    ("transactions", "version_id", "versions"),
    ("transactions", "player_id", "players"),
)
GAPS = {"players": "id % 7 <> 3", "questions": "id % 4 <> 1", "versions": "id <> 2", "answer_options": "id % 5 <> 0", "users": "id % 11 <> 0"}


def _relation_counts(kept: dict[str, str]) -> str:
    """Orphans by relation; of a table named in `kept` only those rows are there."""
    rows = lambda table: f"(select * from s_{table} where {kept.get(table, 'true')})"
    return ctes(
        "users", "versions", "players", "events", "questions", "answer_options", "answers", "transactions"
    ) + " union all ".join(
        f"select '{child}' as child, '{column}' as \"column\", '{parent}' as parent, count(*) as orphans from {rows(child)} c "
        f"where c.{column} is not null and not exists (select 1 from {rows(parent)} p where p.id = c.{column})"
        for child, column, parent in STAND_IN_RELATIONS
    )


def _integrity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = st.tables(spark, sf_dir)
    return integrity_report({name: tables[name].where(GAPS.get(name, "true")) for name in tables})


ORACLES["integrity_report"] = _relation_counts({})
QUERIES["integrity_report_gaps"] = _integrity_gaps
ORACLES["integrity_report_gaps"] = _relation_counts(GAPS)

QUERIES["score_rollup"] = lambda spark, sf: score_rollup(st.table(spark, sf, "events"), GAME)
ORACLES["score_rollup"] = (
    ctes("events")
    + f"select version_id, player_id, coalesce(sum({E_SCORE}), 0) as score from s_events where type = '{GAME}' "
    "group by 1, 2"
)
ROLLED = f", g as (select player_id, sum({E_SCORE}) as s from s_events where type = '{GAME}' group by 1) "
QUERIES["score_reconcile"] = lambda spark, sf: score_mismatches(
    st.table(spark, sf, "players"), st.table(spark, sf, "events"), GAME
)
ORACLES["score_reconcile"] = (
    ctes("players", "events") + ROLLED
    + "select version_id, id as player_id, total_score, coalesce(s, 0) as score from s_players "
    "left join g on g.player_id = id where total_score <> coalesce(s, 0)"
)
QUERIES["score_refresh"] = lambda spark, sf: refresh_total_scores(
    st.table(spark, sf, "players"), st.table(spark, sf, "events"), GAME
).select("id", "version_id", "total_score")
ORACLES["score_refresh"] = (
    ctes("players", "events") + ROLLED
    + "select id, version_id, cast(coalesce(s, 0) as bigint) as total_score from s_players left join g on g.player_id = id"
)
QUERIES["avg_score_per_player"] = lambda spark, sf: average_per_player(st.table(spark, sf, "events"))
ORACLES["avg_score_per_player"] = (
    ctes("events")
    + f", own as (select version_id, player_id, sum({E_SCORE}) as s, count({E_SCORE}) as n from s_events group by 1, 2), "
    "four as (select version_id, (2*s*10000+n)//(2*n) as p from own where n > 0), "
    "eight as (select version_id, count(*) as players, (2*sum(p)*10000+count(*))//(2*count(*)) as q from four group by 1) "
    "select version_id, players, cast((2*q+1000000)//2000000 as double)/100 as avg_score from eight"
)

RANGE = ("2024-01-03 00:00:00", "2024-01-20 00:00:00")
QUERIES["answer_distribution"] = lambda spark, sf: answer_distribution(
    st.table(spark, sf, "questions"), st.table(spark, sf, "answer_options"), st.table(spark, sf, "answers"), *RANGE
)
ORACLES["answer_distribution"] = (
    ctes("questions", "answer_options", "answers")
    + ", d as (select q.version_id, q.code as question_id, q.text as question, o.label as answer, o.position, "
    "count(a.id) as n from s_questions q join s_answer_options o on o.question_id = q.id "
    f"left join s_answers a on a.answer_option_id = o.id and a.occurred_at between timestamp '{RANGE[0]}' "
    f"and timestamp '{RANGE[1]}' group by 1, 2, 3, 4, 5), "
    "t as (select *, sum(n) over (partition by version_id, question_id) as total from d) "
    "select version_id, question_id, question, answer, position, n as answers_count, "
    "cast((2*n*10000 + nullif(total, 0)) // (2*nullif(total, 0)) as double)/10000 as percentage from t"
)
# A range that one day covers, so that options without answers show up.
QUIET = ("2024-02-29 00:00:00", "2024-02-29 00:00:00")
QUERIES["answer_distribution_zero"] = lambda spark, sf: answer_distribution(
    st.table(spark, sf, "questions"), st.table(spark, sf, "answer_options"), st.table(spark, sf, "answers"), *QUIET
)
ORACLES["answer_distribution_zero"] = ORACLES["answer_distribution"].replace(RANGE[0], QUIET[0]).replace(
    RANGE[1], QUIET[1]
)
QUERIES["answer_correctness"] = lambda spark, sf: answer_correctness(
    st.table(spark, sf, "answer_options"), st.table(spark, sf, "answers")
)
ORACLES["answer_correctness"] = (
    ctes("answer_options", "answers")
    + ", g as (select a.version_id, a.question_id, count(*) as answers, "
    "count(*) filter (o.is_correct) as correct from s_answers a "
    "join s_answer_options o on o.id = a.answer_option_id where o.is_correct is not null group by 1, 2) "
    "select *, cast((2*correct*10000 + answers) // (2*answers) as double)/10000 as share from g"
)
