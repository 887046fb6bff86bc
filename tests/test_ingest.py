"""Ingest jobs end to end on a store in a temporary folder."""

from __future__ import annotations

import json
import re
from dataclasses import replace
from datetime import datetime
from pathlib import Path

import pytest
from helpers import batch, rows_of, seed, with_players, with_versions
from pyspark.sql import functions as F

from campaignlake.ingest import jobs
from campaignlake.ingest.jobs import Counters, refresh_scores, run_documents, run_import
from campaignlake.ingest.ledger import ImportLedger, UnknownVersion, create_version
from campaignlake.operators.validate import BatchRejected
from campaignlake.plans import ranks
from campaignlake.plans.workbook import run_export
from campaignlake.settings import Settings
from campaignlake.sources.batches import explode_documents, read_documents, with_ordinal
from campaignlake.sources import tables
from campaignlake.sources.registry import DEFAULT_REGISTRY
from campaignlake.sources.tables import CampaignStore, Commits, latest

AT = "2026-01-15T10:00:00+02:00"


@pytest.fixture
def store(spark, tmp_path):
    return CampaignStore(spark, str(tmp_path / "lake"), buckets=2)


def event(player_id, key=None, kind="opened", payload=None, **more):
    return {"player_id": player_id, "type": kind, "occurred_at": AT, "dedup_key": key, "payload": payload, **more}


def test_events_replay_keyless_and_unresolved(spark, store):
    with_players(store, "alice", "bob")
    rows = [
        event(1, "k1", payload={"language": " it ", "score": 3}),
        event(1, "k1"),
        event(999, "k2", player_email="bob@example.com"),
        event(999, "k3"),
        event(2, "  "),
        event(2, None),
    ]
    first = run_import(store, "events", batch(spark, "events", rows))
    assert first == Counters(processed=6, inserted=4, duplicates=1, failed=1)
    # An unresolved row never claims its key.
    again = run_import(store, "events", batch(spark, "events", [*rows, event(1, "k3")]))
    assert again == Counters(processed=7, inserted=3, duplicates=3, failed=1)
    got = store.read("events")
    assert got.count() == 7 and got.select("id").distinct().count() == 7
    stored = got.where("dedup_key = 'k1'").first()
    assert (json.loads(stored.payload), stored.payload_language, stored.payload_score) == ({"language": "it", "score": 3}, "it", 3)
    assert str(stored.occurred_at) == "2026-01-15 08:00:00" or stored.occurred_at.hour == 8
    assert got.where("dedup_key = 'k2'").first().player_id == 2
    assert got.where("dedup_key is null").first().payload == "[]"


def test_the_same_import_runs_once(spark, store):
    with_players(store, "alice")
    rows = batch(spark, "events", [event(1)])
    assert run_import(store, "events", rows, "job-1").inserted == 1
    assert run_import(store, "events", rows, "job-1") is None
    assert store.read("events").count() == 1


def test_retry_after_failure_replaces_what_the_first_try_wrote(spark, store, monkeypatch):
    with_players(store, "alice")
    reward = ("reward_granted", {"reward_type": "coupon"})
    rows = batch(spark, "events", [event(1, "k1", *reward), event(1, None, *reward)])
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "_write_typed", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run_import(store, "events", rows, "job-1")
    state = ImportLedger(store).state("job-1")
    assert state["status"] == "failed" and "lost" in state["error_message"]
    assert run_import(store, "events", rows, "job-1") == Counters(2, 2, 0, 0)
    assert store.read("events").count() == store.read("rewards").count() == 2
    done = ImportLedger(store).state("job-1")
    assert (done["status"], done["attempts"], done["inserted"]) == ("completed", 2, 2)


def test_versions_are_apart(spark, store):
    with_players(store, "alice", version_id=1)
    rows = [event(1, "k"), {**event(1, "k"), "version_id": 2}]
    assert run_import(store, "events", batch(spark, "events", rows)) == Counters(2, 1, 0, 1)


def catalogue(store):
    seed(store, "questions", [{"id": 10, "version_id": 1, "code": "Q1"}, {"id": 11, "version_id": 2, "code": "Q1"}])
    seed(store, "answer_options", [{"id": 100, "version_id": 1, "question_id": 10, "label": "A"}])


def test_typed_records_follow_their_event(spark, store):
    with_players(store, "zora", "milan", "ines")
    catalogue(store)
    rows = [
        event(1, "a", "transaction", {"type": "spend", "amount": "0.75", "currency": "CHF"}),
        event(2, "b", "reward_granted", {"reward_type": "badge", "reward_code": "GOLD-7"}),
        event(3, "c", "transaction", {"type": "refund", "amount": 41, "currency": "SEK", "status": "failed"}),
        event(1, "d", "answer_submitted", {"question_id": 10, "answer_option_id": 100}),
        event(1, "e", "answer_submitted", {"question_id": 10, "answer_text": "again"}),
    ]
    assert run_import(store, "events", batch(spark, "events", rows)) == Counters(5, 5, 0, 0, 0)
    owner = {r.id: (r.player_id, r.dedup_key) for r in store.read("events").collect()}
    tx = store.read("transactions").orderBy("id").collect()
    assert [(owner[t.event_id], t.player_id, float(t.amount), t.status) for t in tx] == [
        ((1, "a"), 1, 0.75, "completed"), ((3, "c"), 3, 41.0, "failed"),
    ]
    assert [(owner[r.event_id], r.status, str(r.granted_at)[:10]) for r in store.read("rewards").collect()] == [
        ((2, "b"), "granted", "2026-01-15")
    ]
    # One answer per player and question: the first stays, the second event keeps no answer.
    assert rows_of(store.read("answers"), "player_id", "question_id", "answer_option_id", "answer_text") == [
        (1, 10, 100, None)
    ]
    # A replay adds neither events nor typed rows.
    assert run_import(store, "events", batch(spark, "events", rows)) == Counters(5, 0, 5, 0, 0)
    assert store.read("transactions").count() == 2


def test_typed_skips_keep_the_event(spark, store):
    with_players(store, "alice")
    catalogue(store)
    payloads = [
        ("answer_submitted", {"answer_option_id": 100}, "missing field 'question_id'"),
        ("answer_submitted", {"question_id": 10}, "require_any not satisfied"),
        ("answer_submitted", {"question_id": 11, "answer_option_id": 100}, "unknown question '11'"),
        ("answer_submitted", {"question_id": 10, "answer_option_id": 7}, "unknown answer_option '7'"),
        ("transaction", {"type": "purchase", "currency": "EUR"}, "missing field 'amount'"),
        ("transaction", {"type": "bonus", "amount": 5, "currency": "EUR"}, "invalid value for 'type'"),
        ("transaction", {"type": "spend", "amount": "lots", "currency": "EUR"}, "non-numeric 'amount'"),
        ("transaction", {"type": "spend", "amount": 1e12, "currency": "EUR"}, "out of range 'amount'"),
        ("transaction", {"type": "spend", "amount": 1, "currency": "EURO"}, "too long 'currency'"),
        ("reward_granted", {"reward_code": "NOPE"}, "missing field 'reward_type'"),
    ]
    rows = [event(1, f"s{i}", kind, payload) for i, (kind, payload, _) in enumerate(payloads)]
    got = run_import(store, "events", batch(spark, "events", rows))
    assert got == Counters(10, 10, 0, 0, skipped=10)
    assert sorted(r.reason for r in store.read("typed_skipped").collect()) == sorted(p[2] for p in payloads)
    assert store.read("answers").count() + store.read("transactions").count() + store.read("rewards").count() == 0


def player(name, **more):
    return {"email": f"{name}@example.com", **more}


def test_players_upsert(spark, store):
    with_versions(store)
    rows = [player("a", external_id="x1", language="it", registered_at=AT), player("b")]
    assert run_import(store, "players", batch(spark, "players", rows)) == Counters(2, 2, 0, 0)
    assert run_import(store, "players", batch(spark, "players", rows)) == Counters(2, 0, 2, 0)
    # total_score survives, the other fields are replaced, NULLs included.
    scored = store.read("players").drop("bucket")
    staged = store.stage(scored.selectExpr("* except (total_score)", "50 as total_score"), "t", "score")
    store.replace_buckets(staged, "players")
    assert run_import(store, "players", batch(spark, "players", [player("a", language="es")])).duplicates == 1
    got = store.read("players").join(store.read("users").selectExpr("id user_id", "email", "external_id"), "user_id")
    assert rows_of(got, "email", "external_id", "language", "registered_at", "total_score") == [
        ("a@example.com", None, "es", None, 50), ("b@example.com", None, None, None, 50),
    ]
    # The same user in another version is a new player, not a new user.
    other = batch(spark, "players", [player("a"), player("c")], version_id=2)
    assert run_import(store, "players", other).inserted == 2
    assert store.read("users").count() == 3 and store.read("players").count() == 4
    assert store.read("players").select("id").distinct().count() == 4


def test_player_counters_depend_on_chunks(spark, store):
    with_versions(store)
    rows = batch(spark, "players", [player("a"), player("a"), player("b"), player("a", language="fr")])
    got = run_import(store, "players", rows, settings=Settings(chunk_size=2))
    assert (got.inserted, got.duplicates) == (2, 1)
    assert rows_of(store.read("players"), "language") == [("fr",), (None,)]


def test_external_id_of_another_player_fails(spark, store):
    with_versions(store)
    run_import(store, "players", batch(spark, "players", [player("a", external_id="x")]))
    got = run_import(
        store, "players",
        batch(spark, "players", [player("b", external_id="x"), player("c", external_id="y"), player("d", external_id="y")]),
    )
    assert (got.inserted, got.failed) == (1, 2)


def test_direct_transactions_and_rewards(spark, store):
    with_players(store, "alice")
    tx = [{"player_id": 1, "type": "spend", "amount": "10.5", "currency": "EUR", "occurred_at": AT, "dedup_key": k}
          for k in ("t1", "t1", None)] + [{"player_id": 5, "type": "spend", "amount": 1, "currency": "EUR", "occurred_at": AT}]
    tx.append({"player_id": 1, "type": "spend", "amount": "1e11", "currency": "EUR", "occurred_at": AT})
    assert run_import(store, "transactions", batch(spark, "transactions", tx)) == Counters(5, 2, 1, 2)
    assert run_import(store, "transactions", batch(spark, "transactions", tx)) == Counters(5, 1, 2, 2)
    assert {r.status for r in store.read("transactions").collect()} == {"completed"}
    rw = [{"player_id": 1, "reward_type": "badge", "granted_at": AT, "dedup_key": "r1"},
          {"player_id": 1, "reward_type": "badge", "granted_at": AT, "redeemed_at": AT, "status": "redeemed"}]
    assert run_import(store, "rewards", batch(spark, "rewards", rw)) == Counters(2, 2, 0, 0)
    assert rows_of(store.read("rewards"), "status", "dedup_key") == [("granted", "r1"), ("redeemed", None)]


def test_direct_answers(spark, store):
    with_players(store, "alice", "bob")
    catalogue(store)
    rows = [
        {"player_id": 1, "question_id": 10, "answer_option_id": 100, "occurred_at": AT},
        {"player_id": 1, "question_id": 10, "answer_text": "x", "occurred_at": AT},
        {"player_id": 2, "question_id": 11, "answer_text": "other version", "occurred_at": AT},
        {"player_id": 2, "question_id": 10, "answer_option_id": 5, "occurred_at": AT},
        {"player_id": 2, "question_id": 10, "answer_text": "open", "occurred_at": AT},
        {"player_id": 7, "question_id": 10, "answer_text": "nobody", "occurred_at": AT},
    ]
    assert run_import(store, "answers", batch(spark, "answers", rows)) == Counters(6, 2, 1, 3)
    assert run_import(store, "answers", batch(spark, "answers", rows)) == Counters(6, 0, 3, 3)


def test_a_bad_row_rejects_the_batch_or_is_quarantined(spark, store):
    with_players(store, "alice")
    rows = batch(spark, "events", [event(1, "ok"), event("abc"), event(1, payload="text"), event(1, kind="")])
    with pytest.raises(BatchRejected):
        run_import(store, "events", rows)
    assert store.read("events").count() == 0
    got = run_import(store, "events", rows, "q1", mode="quarantine")
    assert got == Counters(1, 1, 0, 0, rejected=3)
    kept = spark.read.parquet(store.path("rejected/events/q1")).selectExpr("inline(errors)")
    assert rows_of(kept, "field", "rule") == [("payload", "array"), ("player_id", "integer"), ("type", "required")]
    with pytest.raises(BatchRejected):
        run_import(store, "events", batch(spark, "events", []))
    with pytest.raises(BatchRejected):
        run_import(store, "events", rows, settings=Settings(max_batch_rows=2))


def test_documents_keep_arrival_order_and_raw_values(spark, store, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text(json.dumps({"version_id": 1, "events": [
        event(1, "a1", payload={"n": {"deep": [1, 2]}}), event("7", "a2")]}, indent=1))
    (landing / "b.json").write_text(json.dumps({"version_id": 1, "events": [event(1, "b1", payload="text")]}))
    rows = with_ordinal(explode_documents(read_documents(spark, str(landing), "events"), "events"))
    got = rows.orderBy("ord").collect()
    assert [r.dedup_key for r in got] == ["a1", "a2", "b1"] and len({r.ord for r in got}) == 3
    assert json.loads(got[0].payload) == {"n": {"deep": [1, 2]}}
    assert (got[1].player_id, got[2].payload) == ("7", "text")


def test_versions(store):
    first, second = create_version(store, {"name": "Spring"}), create_version(store, {"name": "Fall", "status": "active"})
    got = {r.id: r for r in store.read("versions").collect()}
    assert (got[first].status, got[second].status) == ("draft", "active")
    assert len(got[first].uuid) == 36 and first != second


def test_wiping_a_version_leaves_the_others(spark, store):
    seed(store, "events", [{"id": 1, "version_id": 1}, {"id": 2, "version_id": 2}])
    seed(store, "questions", [{"id": 10, "version_id": 1}, {"id": 20, "version_id": 2}])
    seed(store, "users", [{"id": 1, "email": "demo-a@x"}, {"id": 2, "email": "b@x"}])
    seed(store, "players", [{"id": 1, "version_id": 1, "user_id": 1}, {"id": 2, "version_id": 2, "user_id": 2}])
    store.wipe_version(1, email_prefix="demo-")
    left = {t: rows_of(store.read(t), "id") for t in ("events", "questions", "users", "players")}
    assert left == {"events": [(2,)], "questions": [(20,)], "users": [(2,)], "players": [(2,)]}


def test_a_failed_import_leaves_nothing_and_its_ids_are_gone(spark, store, monkeypatch):
    with_players(store, "zora")
    rows = batch(spark, "events", [event(1, "k1"), event(1, None)])
    with monkeypatch.context() as patch:
        patch.setattr(jobs.Job, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run_import(store, "events", rows, "x")
    assert store.read("events").count() == 0
    run_import(store, "events", batch(spark, "events", [event(1, "k2")]), "y")
    assert run_import(store, "events", rows, "x").inserted == 2
    ids = [r.id for r in store.read("events").collect()]
    assert len(ids) == len(set(ids)) == 3 and min(ids) > 2


class Killed(BaseException):
    """A driver's death: nothing handles it."""


def test_a_driver_lost_between_two_tables_shows_neither(spark, store, monkeypatch):
    with_players(store, "zora")
    rows = batch(spark, "events", [event(1, "k", "reward_granted", {"reward_type": "badge"}), event(1, "g", "game_completed", {"score": 7})])
    append = CampaignStore.append_log

    def killed(self, frame, table, *more):
        append(self, frame, table, *more)
        if table == "rewards":
            raise Killed

    with monkeypatch.context() as patch:
        patch.setattr(CampaignStore, "append_log", killed)
        with pytest.raises(Killed):
            run_import(store, "events", rows, "dead")
    left = lambda: {t: store.read(t).count() for t in ("events", "rewards")}
    assert left() == {"events": 0, "rewards": 0} and ImportLedger(store).state("dead")["status"] == "processing"
    assert spark.read.parquet(store.path("events")).count() == 2 and spark.read.parquet(store.path("rewards")).count() == 1
    # The next import settles the lost one, once; the keys it wrote are free again.
    run_import(store, "events", batch(spark, "events", [event(1, "k")]), "next")
    state = ImportLedger(store).state("dead")
    assert state["status"] == "failed" and ImportLedger(store).unfinished() == [] and jobs.recover(store) == []
    assert left() == {"events": 1, "rewards": 0}
    assert run_import(store, "events", rows, "dead") == Counters(2, 1, 1, 0)
    assert left() == {"events": 2, "rewards": 0} and rows_of(store.read("players"), "total_score") == [(7,)]
    ids = [r.id for r in store.read("events").collect()]
    assert len(ids) == len(set(ids)) and min(ids) > 2


def test_a_commit_stands_when_the_ledger_was_not_told(spark, store, monkeypatch):
    with_players(store, "zora")
    commit = Commits.commit

    def killed(self, *a):
        commit(self, *a)
        raise Killed

    with monkeypatch.context() as patch:
        patch.setattr(Commits, "commit", killed)
        with pytest.raises(Killed):
            run_import(store, "events", batch(spark, "events", [event(1, "k"), event(1, "k")]), "x")
    assert store.read("events").count() == 1
    assert run_import(store, "events", batch(spark, "events", [event(1, "k")]), "x") is None
    state = ImportLedger(store).state("x")
    assert (state["status"], state["inserted"], state["duplicates"]) == ("completed", 1, 1)


def files_of(store, *folders):
    root = Path(store.root)
    return {str(f.relative_to(root)) for folder in folders for f in (root / folder).rglob("*.parquet")}


def test_an_upsert_writes_no_more_than_its_rows(spark, tmp_path):
    store = CampaignStore(spark, str(tmp_path / "wide"), buckets=16)
    with_versions(store)
    many = [player(f"p{i}", language="it") for i in range(400)]
    run_import(store, "players", batch(spark, "players", many))
    store.compact("users"), store.compact("players")
    base = files_of(store, "users", "players")
    assert len(base) == 32 and not files_of(store, "_changes")
    for k in range(3):
        changed = [player(f"p{i}", language=f"l{k}") for i in range(k, 400, 40)] + [player(f"new{k}")]
        assert run_import(store, "players", batch(spark, "players", changed)).inserted == 1
        assert files_of(store, "users", "players") == base and len(files_of(store, "_changes")) <= 2 * (k + 1)
    want = sorted([("it", 370), ("l0", 10), ("l1", 10), ("l2", 10), (None, 3)], key=str)
    seen = lambda: rows_of(store.read("players").groupBy("language").count(), "language", "count")
    before = store.read("players").drop("bucket").orderBy("id").collect()
    assert seen() == want
    assert store.compact("players") == 3 and store.compact("players") == 0
    assert seen() == want and store.read("players").drop("bucket").orderBy("id").collect() == before
    assert len(files_of(store, "players")) == 16 and store.read("users").count() == 403


def test_a_swap_that_was_cut_short_is_done_again(spark, store, monkeypatch):
    with_players(store, "zora", "milan")
    run_import(store, "players", batch(spark, "players", [player("zora", language="hr")]))
    with monkeypatch.context() as patch:
        patch.setattr(CampaignStore, "_write", lambda *a: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            store.compact("players")
    staged = spark.read.parquet(*map(str, Path(store.root, "_staging").glob("swap-*/players")))
    for r in staged.select("version_id", "bucket").distinct().collect():
        for part in Path(store.root, f"players/version_id={r.version_id}/bucket={r.bucket}").iterdir():
            part.unlink()
    jobs.recover(store)
    assert rows_of(store.read("players"), "id", "language") == [(1, "hr"), (2, None)] and not list(Path(store.root, "_swaps").glob("swap*"))


def test_commit_files_and_state_logs_stay_few(spark, store, monkeypatch):
    monkeypatch.setattr(tables, "MAX_COMMITS", 6)
    monkeypatch.setattr(tables, "MAX_LOG_FILES", 5)
    monkeypatch.setattr(tables, "MAX_CHANGES", 2)
    with_players(store, "zora")
    for k in range(9):
        rows = batch(spark, "events", [event(1, f"k{k // 2}", "game_completed", {"score": 1})])
        if k % 3 == 2:
            with monkeypatch.context() as patch:
                patch.setattr(jobs.Job, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("no")))
                with pytest.raises(RuntimeError):
                    run_import(store, "events", rows, f"i{k}")
        else:
            run_import(store, "events", rows, f"i{k}")
    assert len(list(Path(store.root, "_commits").glob("[0-9]*"))) <= 14 and len(store._change_numbers("players")) <= 3
    assert sum(len(list(Path(p).glob("*.parquet"))) for p in store.log_paths("import_log")) <= 6
    assert rows_of(store.read("events"), "dedup_key") == [("k0",), ("k1",), ("k2",), ("k3",)]
    assert rows_of(store.read("players"), "total_score") == [(4,)]
    states = latest(store.read("import_log"), "import_id")
    assert rows_of(states.groupBy("status").count(), "status", "count") == [("completed", 6), ("failed", 3)]
    assert ImportLedger(store).state("i0")["inserted"] == 1 and run_import(store, "events", batch(spark, "events", [event(1)]), "i0") is None


def test_a_small_batch_is_checked_against_few_splits(spark, tmp_path):
    store = CampaignStore(spark, str(tmp_path / "wide"), buckets=64)
    with_players(store, "zora")
    stored = [{"id": i, "version_id": 1, "player_id": 1, "type": "x", "occurred_at": datetime(2026, 1, 1 + i % 20), "dedup_key": f"k{i}"} for i in range(2000)]
    seed(store, "events", stored)
    rows = batch(spark, "events", [event(1, f"k{i * 300}") for i in range(4)])
    wanted = jobs.event_candidates(rows)
    index = store.stored_keys("events", wanted, [1])
    opened = {f.split("split=")[1].split("/")[0] for f in index.inputFiles()}
    assert len(opened) == 64
    plan = index._jdf.queryExecution().executedPlan().toString()
    splits = {r[0] for r in wanted.select(store._split_of(F.col("dedup_key"))).collect()}
    assert "PartitionFilters" in plan and all(f"split=" not in line or "events" in line for line in plan.splitlines())
    read = {r[0].split("split=")[1].split("/")[0] for r in index.select(F.input_file_name()).distinct().collect()}
    assert read == {str(s) for s in splits} and len(read) <= 4
    assert run_import(store, "events", rows) == Counters(4, 0, 4, 0)
    # Days of the log are rewritten without changing a row.
    before = store.read("events").orderBy("id").collect()
    run_import(store, "events", batch(spark, "events", [{**event(1, "late"), "occurred_at": "2026-01-03T00:00:00Z"}]))
    assert len(list(Path(store.root, "events/version_id=1/day=2026-01-03").glob("*.parquet"))) == 2
    store.compact_log("events", [1], "2026-01-01", "2026-01-05")
    assert len(list(Path(store.root, "events/version_id=1/day=2026-01-03").glob("*.parquet"))) == 1
    assert store.read("events").where("dedup_key <> 'late'").orderBy("id").collect() == before


def test_retry_of_a_players_import_keeps_what_came_between(spark, store, monkeypatch):
    with_versions(store)
    first = batch(spark, "players", [player("a"), player("b")])
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "merge_players", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run_import(store, "players", first, "x")
    run_import(store, "players", batch(spark, "players", [player("b"), player("c")]), "y")
    corrected = batch(spark, "players", [player("a"), player("b", language="sv")])
    assert run_import(store, "players", corrected, "x").inserted == 1
    users, players = store.read("users").collect(), store.read("players").collect()
    assert sorted(u.email for u in users) == ["a@example.com", "b@example.com", "c@example.com"]
    assert len({u.id for u in users}) == len({p.id for p in players}) == len(players) == 3
    assert [p.language for p in players if p.language] == ["sv"]


def test_a_store_keeps_its_bucket_count(spark, store):
    with_players(store, "zora")
    assert CampaignStore(spark, store.root).buckets == 2
    with pytest.raises(ValueError, match="2 buckets"):
        CampaignStore(spark, store.root, buckets=8)


def test_unknown_and_trashed_versions_are_refused(spark, store):
    seed(store, "versions", [{"id": 1}, {"id": 2, "deleted_at": datetime(2026, 1, 1)}])
    for version in (2, 3):
        with pytest.raises(UnknownVersion):
            run_import(store, "events", batch(spark, "events", [event(1)], version_id=version))
        with pytest.raises(UnknownVersion):
            run_export(store, {}, version)


def test_no_document_is_lost(spark, store, tmp_path):
    with_players(store, "zora")
    landing = tmp_path / "in"
    landing.mkdir()
    documents = {
        "good": json.dumps({"version_id": 1, "events": [event(1, "a"), event(1, "b")]}),
        "truncated": json.dumps({"version_id": 1, "events": [event(1, "c")]})[:-9],
        "object": json.dumps({"version_id": 1, "events": {"0": event(1, "d")}}),
        "text_version": json.dumps({"version_id": "one", "events": [event(1, "e")]}),
        "no_version": json.dumps({"events": [event(1, "f")]}),
        "unknown_version": json.dumps({"version_id": 77, "events": [event(1, "g")]}),
        "empty": json.dumps({"version_id": 1, "events": []}),
        "other": json.dumps({"version_id": 1, "players": []}),
        "long": json.dumps({"version_id": 1, "events": [event(1, f"l{i}") for i in range(4)]}),
    }
    for name, text in documents.items():
        (landing / f"{name}.json").write_text(text)
    found = read_documents(spark, str(landing), "events")
    with pytest.raises(BatchRejected, match="unreadable"):
        run_documents(store, "events", found)
    assert store.read("events").count() == 0
    got = run_documents(store, "events", found, "q", "quarantine", Settings(max_batch_rows=3))
    assert (got.inserted, got.rejected_documents) == (2, 8)
    kept = spark.read.parquet(store.path("rejected/documents/events/q"))
    reasons = {r.file.rsplit("/", 1)[1][:-5]: r.reason for r in kept.collect()}
    assert reasons == {
        "truncated": "unreadable", "object": "unreadable", "text_version": "unknown version", "no_version": "no version",
        "unknown_version": "unknown version", "empty": "no rows", "other": "no rows", "long": "too many rows",
    }
    assert kept.where("text is null or text = ''").count() == 0


def test_ordinals_have_no_gaps(spark):
    rows = spark.range(300).selectExpr(
        "'f' || cast(id % 7 as string) as file", "timestamp'2026-01-01' + make_interval(0,0,0,0,cast(id % 7 % 3 as int)) as arrived",
        "cast(id div 7 as int) as position", "id",
    )
    got = with_ordinal(rows).collect()
    assert sorted(r.ord for r in got) == list(range(300))


def test_scores_are_written_back(spark, store):
    with_players(store, "zora", "milan")
    seed(store, "events", [
        {"id": i, "version_id": 1, "player_id": 1, "type": "game_completed", "payload_score": 2_000_000_000, "payload": "[]"} for i in (1, 2)
    ])
    assert refresh_scores(store) == 1 and refresh_scores(store) == 0
    assert rows_of(store.read("players"), "id", "total_score") == [(1, 4_000_000_000), (2, 0)]


def test_replay_puts_the_present_rules_in_place(spark, store, monkeypatch):
    """Rules, players and a bad row change after the import; a replay takes them up, once and at once."""
    with_players(store, "zora")
    catalogue(store)
    rows = [
        event(1, "a", "transaction", {"type": "gift", "amount": "3", "currency": "CHF"}),
        event(1, "b", "reward_granted", {"reward_type": "badge"}),
        event(1, None, "game_completed", {"score": 5}),
        event(2, "d", "game_completed", {"score": 7}),
        event(1, "e", "transaction", {"type": "spend", "amount": "1", "currency": "CHF"}),
        event("nobody", "f"),
    ]
    assert run_import(store, "events", batch(spark, "events", rows), "x", "quarantine") == Counters(5, 4, 0, 1, 1, 1)
    ids = {r.dedup_key: r.id for r in store.read("events").collect()}
    assert jobs.replay(store, "x").count() == 0 and store.read("events").count() == 4
    # Another import, whose scores and keys stay as they are.
    run_import(store, "events", batch(spark, "events", [event(1, "d2", "game_completed", {"score": 100}), event(1, "a")]), "y")
    run_import(store, "players", batch(spark, "players", [player("milan")]))
    milan = store.read("players").where("id <> 1").first().id
    raw = store.path("raw/events/x")
    mended = spark.read.parquet(raw).withColumn("player_id", F.when(F.col("player_id") == "2", str(milan)).otherwise(F.col("player_id")))
    mended.write.parquet(raw + "-mended")
    spark.read.parquet(raw + "-mended").write.mode("overwrite").parquet(raw)
    typed = DEFAULT_REGISTRY.typed
    gifts = replace(typed["transaction"], fields=tuple(replace(f, one_of=("gift", "spend")) if f.key == "type" else f for f in typed["transaction"].fields))
    codes = replace(typed["reward_granted"], fields=tuple(replace(f, required=True) for f in typed["reward_granted"].fields))
    registry = replace(DEFAULT_REGISTRY, typed={**typed, "transaction": gifts, "reward_granted": codes})
    with monkeypatch.context() as patch:
        patch.setattr(Commits, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            jobs.replay(store, "x", registry=registry)
    assert store.read("events").count() == 5 and store.read("rewards").count() == 1 and ImportLedger(store).state("x")["status"] == "completed"
    found = jobs.replay(store, "x", registry=registry)
    assert rows_of(found, "stored", "change") == [("events", "added"), ("rewards", "removed"), ("transactions", "added")]
    now = {r.dedup_key: r.id for r in store.read("events").where("batch_id = 'x'").collect()}
    assert {k: v for k, v in now.items() if k != "d"} == ids and len(now) == 5
    assert store.read("rewards").count() == 0 and store.read("transactions").count() == 2
    assert rows_of(store.read("typed_skipped"), "reason") == [("missing field 'reward_code'",)]
    assert rows_of(store.read("players"), "id", "total_score") == [(1, 105), (milan, 7)]
    state = ImportLedger(store).state("x")
    assert (state["inserted"], state["failed"], state["rejected"], state["attempts"]) == (5, 0, 1, 3)
    assert jobs.replay(store, "x", registry=registry).count() == 0 and store.read("events").count() == 6
    with pytest.raises(ValueError):
        jobs.replay(store, "no such import")


def test_a_deep_page_opens_one_range(spark, tmp_path):
    store = CampaignStore(spark, str(tmp_path / "lake"), buckets=8)
    with_players(store, *[f"p{i:03}" for i in range(200)])
    assert ranks.build_ranks(store, 1, rows_per_range=20) >= 8
    for page in (1, 9, 20, 21):
        ids = ranks.page_ids(store, 1, page, 10)
        ranges = re.findall(r"PartitionFilters: \[[^]]*range#\d+ (?:= |IN \()([\d,]+)", ids._jdf.queryExecution().executedPlan().toString())
        assert (page == 21) == (not ranges) and all(len(r.split(",")) <= 2 for r in ranges)
        assert [r.id for r in ids.orderBy("id").collect()] == list(range(10 * page - 9, min(10 * page, 200) + 1))
    run_import(store, "players", batch(spark, "players", [player("late"), player("p000", language="sv")]))
    assert [r.email for r in ranks.ranked_page(store, 1, 21, 10).collect()] == ["late@example.com"]
    assert ranks.ranked_page(store, 1, 1, 10).first().language == "sv"
    assert ranks.build_ranks(store, 1, rows_per_range=300) == 1 and len(list(Path(store.rank_path(1)).iterdir())) == 1
    assert [r.email for r in ranks.ranked_page(store, 1, 21, 10).collect()] == ["late@example.com"]
    store.wipe_version(1)
    assert ranks.ranked_page(store, 1, 1, 10).collect() == []


def test_short_ranges_share_directories(spark, tmp_path):
    store = CampaignStore(spark, str(tmp_path / "lake"), buckets=2)
    with_players(store, *[f"p{i:03d}" for i in range(150)])
    assert ranks.build_ranks(store, 1, rows_per_range=7) == 22
    build = next(Path(store.rank_path(1)).iterdir())
    assert [d.name for d in (build / "ids").iterdir() if d.is_dir()] == ["range=0"]
    ids = ranks.page_ids(store, 1, 4, 10)
    assert sorted(r.id for r in ids.collect()) == list(range(31, 41))


def test_pieces_of_several_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranks, "MIN_RANGE_ROWS", 40)
    store = CampaignStore(spark, str(tmp_path / "lake"), buckets=2)
    with_players(store, *[f"p{i:03d}" for i in range(150)])
    assert ranks.build_ranks(store, 1, rows_per_range=7) >= 22
    assert len([d for d in (next(Path(store.rank_path(1)).iterdir()) / "ids").iterdir() if d.is_dir()]) > 2
    for page in range(1, 17):
        assert sorted(r.id for r in ranks.page_ids(store, 1, page, 10).collect()) == list(range(page * 10 - 9, min(page * 10, 150) + 1))


def test_a_batch_is_judged_once(spark, store, monkeypatch):
    with_players(store, "alice")
    for mode, rows in (("quarantine", [event(1, "k"), event("no number", "bad")]), ("reject_batch", [event(1, " m ")])):
        seen = []
        original = jobs.JOBS["events"]
        monkeypatch.setitem(jobs.JOBS, "events", lambda job, good, original=original: seen.append(good.inputFiles()) or original(job, good))
        assert run_import(store, "events", batch(spark, "events", rows), mode, mode).inserted == 1
        monkeypatch.setitem(jobs.JOBS, "events", original)
        # What the job reads has been trimmed and judged already; the raw copy is not read again.
        assert seen[0] and all("/_staging/" in file for file in seen[0])
    with pytest.raises(BatchRejected):
        run_import(store, "events", batch(spark, "events", [event("no number")]), "refused")
    assert sorted(r.dedup_key for r in store.read("events").collect()) == ["k", "m"]
    assert not (Path(store.root) / "_staging" / "refused").exists()
