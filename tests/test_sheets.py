"""Sheets, preview, quality and reports on tiny inputs with exact results."""

from __future__ import annotations

import json
import random
from datetime import datetime

import pytest
from helpers import frame, rows_of
from pyspark.sql import functions as F

from campaignlake.functions.normalize import blank_to_null, is_date, is_email, is_integer, is_numeric, to_utc
from campaignlake.functions.payload import (
    is_empty_payload,
    with_payload_columns,
    with_stored_payload,
)
from campaignlake.operators.distribution import answer_distribution
from campaignlake.operators.integrity import integrity_report
from campaignlake.operators.predicates import predicate
from campaignlake.operators.quality import quality_report
from campaignlake.operators.scores import score_mismatches
from campaignlake.plans.preview import player_count, preview, sheet_page
from campaignlake.plans.sheet import compile_sheet, sheet_row_count
from campaignlake.plans.spec import parse_spec
from campaignlake.settings import Settings

JAN = datetime(2026, 1, 10, 12)


def event(i, player, payload, kind="game_completed", when=JAN, version_id=1):
    return {"id": i, "version_id": version_id, "player_id": player, "type": kind, "occurred_at": when,
            "payload": payload}


@pytest.fixture(scope="module")
def tables(spark):
    def raw(rows):
        return frame(spark, "events", rows).drop("payload_language", "payload_utm_source", "payload_score")

    return {
        "events": raw(
            [
                event(1, 1, '{"language":"sv","utm_source":"newsletter","score":37}'),
                event(2, 2, '{"language":"sv","utm_source":"newsletter","score":64}'),
                event(3, 1, '{"language":"en","utm_source":"billboard","score":0}', "answer_submitted"),
                event(4, 9, '{"language":"it","score":7}', version_id=2),
            ]
        ),
        "players": frame(
            spark, "players",
            [
                {"id": 1, "version_id": 1, "user_id": 11, "language": "it", "total_score": 37,
                 "registered_at": datetime(2026, 1, 1)},
                {"id": 2, "version_id": 1, "user_id": 12, "language": "it", "total_score": 5,
                 "registered_at": datetime(2026, 1, 20)},
                {"id": 3, "version_id": 1, "user_id": 13, "language": "en", "total_score": 0},
                {"id": 9, "version_id": 2, "user_id": 11, "total_score": 7},
            ],
        ),
        "users": frame(spark, "users", [{"id": 11, "email": "a@x"}, {"id": 12, "email": "b@x"}, {"id": 13, "email": "c@x"}]),
    }


def sheet(tables, spec, version_id=1, **params):
    return compile_sheet(parse_spec({"sheets": [spec], **params}).sheets[0], tables, version_id)


def test_summary_segment(tables):
    got = sheet(tables, {"source": "events", "group_by": ["type", "language", "utm_source"],
                         "metrics": ["unique_players", "avg_score", "count"]})
    assert rows_of(got, *got.columns) == [
        ("answer_submitted", "en", "billboard", 1, 0.0, 1),
        ("game_completed", "sv", "newsletter", 2, 50.5, 2),
    ]


def test_detail_filter_and_repeated_labels(tables):
    got = sheet(tables, {"source": "events", "columns": [{"field": "score", "as": "x"}, {"field": "type", "as": "x"}],
                         "filters": {"language": "en"}})
    assert got.columns == ["x", "x"] and [tuple(r) for r in got.collect()] == [(0, "answer_submitted")]


def test_players_sorted_with_key_as_tie_break(tables):
    got = sheet(tables, {"source": "players", "columns": ["email"], "filters": {"language": ["it"]},
                         "sort": ["registered_at:desc"]})
    assert [r.email for r in got.collect()] == ["b@x", "a@x"]


def test_unsorted_detail_follows_the_key(tables):
    assert [r.id for r in sheet(tables, {"source": "events", "columns": ["id"]}).collect()] == [1, 2, 3]


def test_all_versions_in_one_pass(tables):
    got = sheet(tables, {"source": "events", "columns": [{"fn": "count", "as": "n"}]}, version_id=None)
    assert rows_of(got, "version_id", "n") == [(1, 3), (2, 1)]


def test_bare_aggregate_of_nothing_is_one_row(tables):
    spec = {"source": "events", "columns": [{"fn": "count", "as": "n"}, {"fn": "avg", "field": "score", "as": "a"}],
            "filters": {"type": "none"}}
    assert [tuple(r) for r in sheet(tables, spec).collect()] == [(0, None)]
    counted = sheet_row_count(parse_spec({"sheets": [spec]}).sheets[0], tables, 1)
    assert counted.first()["rows"] == 1


def test_date_only_upper_bound_is_midnight(tables):
    spec = {"source": "events", "columns": [{"fn": "count", "as": "n"}]}
    assert sheet(tables, spec, date_to="2026-01-10").first().n == 0
    assert sheet(tables, spec, date_to="2026-01-11").first().n == 3


def test_row_counts(tables):
    def rows(spec):
        return sheet_row_count(parse_spec({"sheets": [spec]}).sheets[0], tables, 1).first()["rows"]

    assert rows({"source": "events", "group_by": ["type"], "metrics": ["count"]}) == 2
    assert rows({"source": "players"}) == 3


def test_preview_truncates_and_keeps_the_last_of_repeated_labels(spark, tables):
    many = spark.range(1, 151).select(
        F.col("id"), F.lit(1).cast("bigint").alias("version_id"), F.lit(1).cast("bigint").alias("player_id"),
        F.lit("t").alias("type"), F.lit(JAN).alias("occurred_at"), F.lit("[]").alias("payload"),
    )
    shown = preview({"sheets": [{"source": "events", "columns": ["id", {"field": "type", "as": "id"}]}]},
                    {**tables, "events": many}, 1)[0]
    assert len(shown["rows"]) == 100 and shown["truncated"] and shown["rows"][0] == {"id": "t"}
    assert not preview({"sheets": [{"source": "events"}]}, tables, 1)[0]["truncated"]


def test_pages_by_key(tables):
    spec = parse_spec({"sheets": [{"source": "players", "columns": ["email"]}]}).sheets[0]
    first = sheet_page(spec, tables, 1, size=2).collect()
    assert [tuple(r) for r in first] == [(1, "a@x"), (2, "b@x")]
    assert [tuple(r) for r in sheet_page(spec, tables, 1, after=2, size=2).collect()] == [(3, "c@x")]
    assert player_count(tables["players"], 1).first()["total"] == 3
    with pytest.raises(ValueError):
        sheet_page(parse_spec({"sheets": [{"source": "events", "sort": ["id"]}]}).sheets[0], tables, 1)


def test_predicates(spark):
    df = spark.createDataFrame([("it", 1), ("en", None)], "t string, n int")

    def kept(op, column, value):
        return [r.t for r in df.where(predicate(op, F.col(column), df.schema[column].dataType, value)).collect()]

    assert kept("in", "t", "it") == ["it"] and kept("in", "t", []) == [] and kept("in", "n", ["1", "x"]) == ["it"]
    assert kept("eq", "n", None) == ["en"] and kept("eq", "n", 1) == ["it"]
    with pytest.raises(ValueError):
        predicate("like", F.col("t"), df.schema["t"].dataType, "x")


def test_payload_functions(spark):
    data = [
        ('{"language":"it","score":87.6}', "it", 88, False, '{"language":"it","score":87.6}'),
        ('{"language":null,"score":"x"}', None, None, False, '{"language":null,"score":"x"}'),
        ('{"language":"  "}', None, None, False, '{"language":null}'),
        ('{"language": "it ", "n": 1}', "it", None, False, '{"language": "it", "n": 1}'),
        ('{"language": "it", "n": {"m": ""}}', "it", None, False, '{"language": "it", "n": {"m": null}}'),
        ('{"language": "\\tit", "n": "a, b"}', "it", None, False, '{"language": "it", "n": "a, b"}'),
        ('{"a": {"b": "  x "}, " k ": [" y ", [""]]}', None, None, False, '{"a": {"b": "x"}, " k ": ["y", [null]]}'),
        ('{"a": " x ", "a": " y "}', None, None, False, '{"a": "x", "a": "y"}'),
        ('{"language": "it", "n": "a b"}', "it", None, False, '{"language": "it", "n": "a b"}'),
        ('[{"language":"it"}]', None, None, False, '[{"language":"it"}]'),
        ("[]", None, None, True, "[]"),
        (" { } ", None, None, True, "[]"),
        ("{}", None, None, True, "[]"),
        ('[1," x "]', None, None, False, '[1,"x"]'),
        ("plain", None, None, False, "[]"),
        (None, None, None, False, "[]"),
    ]
    df = spark.createDataFrame([(d[0],) for d in data], "payload string")
    read = with_payload_columns(df).select(
        blank_to_null(F.col("payload_language")), "payload_score", is_empty_payload(F.col("payload"))
    )
    assert [tuple(r) for r in read.collect()] == [d[1:4] for d in data]
    stored = with_stored_payload(df).collect()
    assert [r.payload for r in stored] == [d[4] for d in data]


def test_field_functions(spark):
    row = spark.sql("select '2026-01-15T10:00:00+02:00' a, '' b, 'x' c, '2026-01-15 10:00:00.9' d")
    got = row.select(*[to_utc(F.col(c)).cast("string") for c in "abcd"]).first()
    assert tuple(got) == ("2026-01-15 08:00:00", None, None, "2026-01-15 10:00:00")

    def ok(check, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
        return [r[0] for r in df.select(F.coalesce(check(F.col("v")), F.lit(False))).collect()]

    assert ok(is_numeric, "1", "-1.5", ".5", "1e3", "lots", "1.2.3") == [True, True, True, True, False, False]
    assert ok(is_integer, "12", "-3", "1.5", "x") == [True, True, False, False]
    assert ok(is_email, "a@b.co", "a@b", "a b@c.d", "ab") == [True, True, False, False]
    assert ok(is_date, "2026-01-15", "2026-01-15T10:00:00Z", "2026-13-01", "10:30") == [True, True, False, False]


def test_quality_checks(spark, tables):
    events = frame(
        spark, "events",
        [event(1, 1, '{"score":10}'), event(2, 1, "[]"), event(3, 2, '{"language":"it"}'),
         event(4, 1, '{"language":"it"}'), event(5, 3, '{"language":"it"}')],
    ).drop("payload_language", "payload_utm_source", "payload_score")
    got = quality_report(events, tables["players"], 1)
    assert rows_of(got, "check", "severity", "occurrences") == [
        ("empty_payload", "info", 1), ("invalid_event_order", "error", 1), ("missing_language", "warning", 2),
    ]


def test_score_reconciliation(tables):
    assert rows_of(score_mismatches(tables["players"], tables["events"]), "player_id", "total_score", "score") == [
        (2, 5, 64)
    ]


def test_distribution_keeps_options_without_answers(spark):
    questions = frame(spark, "questions", [{"id": 1, "version_id": 1, "code": "Q1", "text": "?"},
                                           {"id": 2, "version_id": 1, "code": "Q2", "text": "?"}])
    options = frame(spark, "answer_options", [{"id": i, "question_id": q, "label": f"o{i}", "position": i}
                                              for i, q in ((1, 1), (2, 1), (3, 2))])
    answers = frame(spark, "answers", [{"id": i, "version_id": 1, "answer_option_id": o, "occurred_at": JAN}
                                       for i, o in ((1, 1), (2, 1), (3, None))])
    got = answer_distribution(questions, options, answers, datetime(2026, 1, 1), datetime(2026, 2, 1), 1)
    assert rows_of(got, "answer", "answers_count", "percentage") == [("o1", 2, 1.0), ("o2", 0, 0.0), ("o3", 0, None)]


def test_integrity_report(tables):
    got = {(r["child"], r["column"]): r["orphans"] for r in integrity_report(tables).collect()}
    assert got == {("players", "user_id"): 0, ("events", "player_id"): 0}


def test_payload_trim_equals_a_plain_walk(spark):
    rng = random.Random(2)
    ends = ["", " ", "\t", "\n ", "\u000b", "\\", '"', "\\t", " : ", ", ", "é", "\u0000"]

    def value(depth):
        kind = rng.randrange(6 if depth else 2)
        if kind < 2:
            return "".join(rng.choice(ends) for _ in range(3)) + rng.choice(["", "x", 'a "b" c', "\\"]) + "".join(rng.choice(ends) for _ in range(2))
        if kind == 2:
            return rng.choice([1, 2.5, None, True])
        if kind == 3:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {value(0): value(depth - 1) for _ in range(rng.randrange(4))}

    def walk(v):
        if isinstance(v, str):
            return v.strip(" \t\n\r\0\x0b") or None
        if isinstance(v, list):
            return [walk(x) for x in v]
        return {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else v

    given = [{"k": value(3), "l": [value(2)]} for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(g, ensure_ascii=i % 2 == 0)) for i, g in enumerate(given)], "i int, payload string")
    got = {r.i: json.loads(r.payload) for r in with_stored_payload(df).collect()}
    assert [got[i] for i in range(300)] == [walk(g) for g in given]


def test_distinct_counts_follow_the_collation(tables, spark):
    spec = {"source": "events", "group_by": ["language"], "columns": [{"fn": "count_distinct", "field": "type", "as": "n"}]}
    doubled = tables["events"].withColumn("type", F.when(F.col("id") == 2, "GAME_completed").otherwise(F.col("type")))
    plan = parse_spec({"sheets": [{**spec, "columns": ["language", *spec["columns"]]}]}).sheets[0]
    count = lambda settings: {r[0]: r[1] for r in compile_sheet(plan, {**tables, "events": doubled}, 1, settings=settings).collect()}
    assert count(Settings())["sv"] == 2 and count(Settings(text_collation="UNICODE_CI"))["sv"] == 1


def test_ranks_of_a_sheet_do_not_depend_on_where_a_sort_cuts(spark):
    from suite.sheets import QUERIES

    # Few samples and many parts: two runs of one sort cut it in different places.
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        rows = QUERIES["events_sorted_desc_tiebreak"](spark, "/root/testdata/sf0.01").collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    rows.sort(key=lambda r: (r.score is None, -(r.score or 0), r.occurred_at, r.id))
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
