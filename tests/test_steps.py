"""Steps that every import shares: what they cost a row, read from their plans."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from campaignlake.functions.payload import MAY_NEED_TRIM, with_payload_columns, with_stored_payload
from campaignlake.ingest.jobs import run_import
from campaignlake.operators.merge import merge_players, merge_users
from campaignlake.operators.typed import project_all
from campaignlake.sources.tables import CampaignStore
from helpers import batch, rows_of, with_players


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_blank_ends_of_values_mark_a_payload(spark):
    clean = [json.dumps(v) for v in ({"a": "b", "c": 1, "d": ["x", "y z"]}, {"a b": {"c": "d"}}, [1, "a"])]
    clean += ['{ "a" : "b" , "c" : [ "d" ] }', '{"a":"x y"}']
    marked = ['{"a": " b"}', '{"a": "b\\n"}', '{"a": ""}', '["" , 1]', '{"a": ["b "]}', '{"a":\t"\\u0020"}']
    df = spark.createDataFrame([(p,) for p in clean + marked], "payload string")
    got = {r.payload: r.m for r in df.select("payload", F.col("payload").rlike(MAY_NEED_TRIM).alias("m")).collect()}
    assert [p for p in clean if got[p]] == [] and [p for p in marked if not got[p]] == []


def test_payloads_are_trimmed_without_a_lambda(spark):
    big = json.dumps({f"k {i}": [f" v{i}\t", "", f"w  {i}"] for i in range(20_000)})
    df = with_stored_payload(spark.createDataFrame([(big,), ('{"a" : " \\"x\\" ", " b ": "\\\\"}',)], "payload string"))
    assert "lambda" not in plan(df)
    stored = [json.loads(r.payload) for r in df.collect()]
    assert stored[0] == {f"k {i}": [f"v{i}", None, f"w  {i}"] for i in range(20_000)}
    assert stored[1] == {"a": '"x"', " b ": "\\"}


def test_absent_tables_cost_no_shuffle(spark, tmp_path):
    store = CampaignStore(spark, str(tmp_path / "lake"), buckets=2)
    events = spark.range(5).selectExpr(
        "id", "1L as version_id", "id as player_id", "timestamp'2024-01-01' as occurred_at", "timestamp'2024-01-01' as created_at",
        "'answer_submitted' as type", "'{\"question_id\": 3, \"answer_text\": \"x\"}' as payload",
    )
    projected = project_all(events, {name: store.read(name) for name in ("questions", "answer_options")})
    assert "Join" not in plan(projected)
    assert {r.skip_reason for r in projected.collect()} == {"unknown question '3'"}
    assert store.read("events").schema == store._schema("events").__class__([f for f in store._schema("events") if f.name not in ("batch_no", "day")])


def test_a_typed_value_is_asked_once_whether_it_is_given(spark, tmp_path):
    store = CampaignStore(spark, str(tmp_path / "lake"), buckets=2)
    events = spark.createDataFrame(
        [(1, 1, 1, "transaction", '{"type": "", "amount": 2, "currency": "EUR"}'), (2, 1, 1, "transaction", '{"type": "spend", "amount": "2", "currency": "EUR", "status": ""}')],
        "id long, version_id long, player_id long, type string, payload string",
    ).withColumns({"occurred_at": F.lit("2024-01-01").cast("timestamp"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    projected = project_all(events, {name: store.read(name) for name in ("questions", "answer_options")})
    assert "NOT (_v_" not in plan(projected)
    got = {r.event_id: (r.skip_reason, r.to_transaction and r.to_transaction.status) for r in projected.collect()}
    assert got[1][0] == "missing field 'type'" and got[2] == (None, "completed")


def test_merges_compute_each_side_once(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    users = spark.range(3).selectExpr("id", "'m' || id as email", "'x' || id as external_id", "timestamp'2024-01-01' as created_at", "timestamp'2024-01-01' as updated_at")
    given = spark.range(2, 5).selectExpr("'m' || id as email", "'y' || id as external_id", "id as ord")
    merged = merge_users(users, given, 100, now)
    assert plan(merged).count("Join") == 1
    assert rows_of(merged, "id", "email", "external_id") == [(0, "m0", "x0"), (1, "m1", "x1"), (103, "m3", "y3"), (104, "m4", "y4"), (2, "m2", "y2")]
    players = spark.range(3).selectExpr(
        "id", "1L as version_id", "id as user_id", "timestamp'2024-01-01' as registered_at", "7L as total_score", "'it' as language",
        "timestamp'2024-01-01' as created_at", "timestamp'2024-01-01' as updated_at",
    )
    told = spark.range(2, 4).selectExpr("1L as version_id", "id as user_id", "cast(null as timestamp) as registered_at", "'sv' as language", "2L as chunks", "id as ord")
    merged = merge_players(players, told, 100, now)
    assert plan(merged).count("Join") == 1
    got = rows_of(merged, "id", "total_score", "language", "touched_chunks", "is_new")
    assert got == [(0, 7, "it", 0, False), (1, 7, "it", 0, False), (103, 0, "sv", 2, True), (2, 7, "sv", 2, False)]


def test_rows_of_wanted_keys_come_from_one_pass_over_the_changes(spark, tmp_path):
    store = CampaignStore(spark, str(tmp_path / "lake"), buckets=4)
    with_players(store, *"abcdef")
    for name, language in (("one", "sv"), ("two", "da")):
        rows = [{"email": f"{n}@example.com", "language": language} for n in ("ab" if name == "one" else "bc")]
        run_import(store, "players", batch(spark, "players", rows), name)
    wanted = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4)], "version_id long, user_id long")
    found = store.matching("players", wanted)
    assert rows_of(found, "user_id", "language") == [(1, "sv"), (2, "da"), (3, "da"), (4, None)]
    text = plan(found)
    # Base and changes each meet the wanted keys once; no anti join follows.
    assert text.count("Join") == 2 and "LeftAnti" not in text and text.count("max_by") == 1
    before = rows_of(store.read("players"), "id", "user_id", "language")
    store.compact("players")
    assert rows_of(store.read("players"), "id", "user_id", "language") == before


def test_payloads_without_the_kept_keys_are_not_parsed(spark):
    given = ['{"a": 1}', '{"language": "it"}', '{"l\\u0061nguage": "sv"}', '{"x": "score"}', '[{"score": 2}]', '{"score": "2.6"}', None]
    df = with_payload_columns(spark.createDataFrame([(p,) for p in given], "payload string"))
    assert [(r.payload_language, r.payload_score) for r in df.collect()] == [(None, None), ("it", None), ("sv", None), (None, None), (None, None), (None, 3), (None, None)]
    assert "Contains(payload" in plan(df)


def test_typed_rows_are_staged_once(spark, tmp_path, monkeypatch):
    store = CampaignStore(spark, str(tmp_path / "lake"), buckets=2)
    with_players(store, "ann")
    staged = []
    stage = CampaignStore.stage
    monkeypatch.setattr(CampaignStore, "stage", lambda self, rows, name, attempt: staged.append(name) or stage(self, rows, name, attempt))
    rows = [
        {"player_id": 1, "type": "transaction", "occurred_at": "2024-01-05T10:00:00Z", "payload": {"type": "spend", "amount": 2, "currency": "EUR"}, "dedup_key": "a"},
        {"player_id": 1, "type": "reward_granted", "occurred_at": "2024-01-05T10:00:00Z", "payload": {"reward_type": "badge"}, "dedup_key": "b"},
        {"player_id": 1, "type": "reward_granted", "occurred_at": "2024-01-05T10:00:00Z", "payload": {}, "dedup_key": "c"},
    ]
    done = run_import(store, "events", batch(spark, "events", rows), "A")
    assert "typed" in staged and not [n for n in staged if n.startswith(("log-transactions", "log-rewards", "log-typed_skipped"))]
    assert done.inserted == 3 and done.skipped == 1
    assert rows_of(store.read("transactions"), "amount", "type") != [] and store.read("rewards").count() == 1 and store.read("typed_skipped").count() == 1
