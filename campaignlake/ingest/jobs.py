"""The five ingest jobs. Each is a DataFrame pipeline over all versions of a batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlake import schemas
from campaignlake.functions.normalize import dedup_key, money, to_utc, trim_strings
from campaignlake.functions.payload import with_payload_columns, with_stored_payload
from campaignlake.ingest.ledger import COMPLETED, FAILED, PROCESSING, ImportLedger, new_id, require_live_versions, utc_now
from campaignlake.operators.dedup import new_by_natural_key, new_rows
from campaignlake.operators.keys import flag_existing, touched
from campaignlake.operators.merge import (
    collapse_players,
    collapse_users,
    external_id_clashes,
    merge_players,
    merge_users,
    player_counters,
)
from campaignlake.operators.resolve import resolve_players
from campaignlake.operators.scores import GAME_EVENT, score_mismatches, score_rollup
from campaignlake.operators.sketches import event_sketches
from campaignlake.operators.typed import project_all, records_of, skipped_records
from campaignlake.operators.validate import BatchRejected, refuse_unclean, split_checked, with_errors
from campaignlake.settings import DEFAULT_SETTINGS, Settings
from campaignlake.sources.batches import explode_documents, split_documents, with_ordinal
from campaignlake.sources.registry import DEFAULT_REGISTRY, Registry
from campaignlake.sources.tables import INDEXED_TABLES, CampaignStore, Snapshot, live_versions, natural_key

# Tables that a job gives ids to.
WRITES = {
    "players": ("users", "players"),
    "events": ("events", "answers", "transactions", "rewards"),
    "transactions": ("transactions",),
    "answers": ("answers",),
    "rewards": ("rewards",),
}


@dataclass(frozen=True)
class Counters:
    processed: int
    inserted: int
    duplicates: int
    failed: int
    skipped: int = 0
    rejected: int = 0
    rejected_documents: int = 0



@dataclass(frozen=True)
class Job:
    """What one run needs: where, which batch, the tables as they were when it began, and the batch's single clock
    reading. Rows to store are staged; `publish` writes them all under the batch's number."""

    store: CampaignStore
    batch_id: str
    attempt: str
    now: datetime
    ids: Mapping[str, int]
    settings: Settings = DEFAULT_SETTINGS
    registry: Registry = DEFAULT_REGISTRY
    versions: tuple[int, ...] = ()
    number: int = 0
    at: Snapshot = Snapshot()
    replaces: int | None = None
    logged: list[tuple[DataFrame, str]] = field(default_factory=list)
    changed: list[tuple[DataFrame, str]] = field(default_factory=list)

    def stamp(self) -> Column:
        return F.lit(self.now).cast("timestamp")

    def table(self, name: str) -> DataFrame:
        """A table, pruned to the batch's versions."""
        return self.store.read(name, self.versions, self.at)

    def stage(self, rows: DataFrame, name: str) -> DataFrame:
        return self.store.stage(rows, name, self.attempt)

    def write(self, rows: DataFrame, name: str, label: str = "") -> DataFrame:
        """Rows for a log table, staged; the table gets them when the import is published."""
        staged = self.stage(rows, f"log-{name}{label}")
        self.logged.append((staged, name))
        return staged

    def change(self, rows: DataFrame, name: str) -> DataFrame:
        """Changed and new rows of a merged table, staged like those of `write`."""
        staged = self.stage(rows, f"changed-{name}")
        self.changed.append((staged, name))
        return staged

    def publish(self) -> None:
        """Write what is staged, in any order: nothing is visible before the commit."""
        store, number = self.store, self.number
        with ThreadPoolExecutor(max_workers=4) as pool:
            done = [pool.submit(store.append_log, rows, name, self.batch_id, number) for rows, name in self.logged]
            done += [pool.submit(store.write_changes, rows, name, number) for rows, name in self.changed]
            for one in done:
                one.result()

    def stored_keys(self, name: str, wanted: DataFrame) -> DataFrame:
        """Keys of stored rows among which those of the batch are, from few splits of the index."""
        return self.store.stored_keys(name, wanted, self.versions, self.at)

    def identified(self, candidates: DataFrame) -> DataFrame:
        """Candidates of known players, resolved once and staged. Of the users only those buckets are read that hold
        the batch's e-mails."""
        mails = candidates.select(F.col("player_email").alias("email")).where("email is not null")
        return resolved_rows(candidates, self.table("players"), self.store.in_buckets_of("users", mails, self.at))


# --- candidate rows -----------------------------------------------------------------------------


def event_candidates(rows: DataFrame) -> DataFrame:
    """Trimmed text rows to typed candidates."""
    return rows.select(
        "version_id",
        F.col("player_id").try_cast("bigint").alias("player_id"),
        "player_email",
        "type",
        to_utc(F.col("occurred_at")).alias("occurred_at"),
        "payload",
        dedup_key(F.col("dedup_key")).alias("dedup_key"),
        "ord",
    )


def stored_events(fresh: DataFrame, first_id: int) -> DataFrame:
    """New candidates as they are stored: id, cleaned payload and its extracted keys. This comes
    after the dedup, so that dropped rows are never parsed."""
    return with_payload_columns(with_ids(with_stored_payload(fresh), first_id))


def transaction_candidates(rows: DataFrame) -> DataFrame:
    return rows.select(
        "version_id",
        F.col("player_id").try_cast("bigint").alias("player_id"),
        "player_email",
        "type",
        money(F.col("amount")).alias("amount"),
        "currency",
        F.coalesce("status", F.lit("completed")).alias("status"),
        "external_ref",
        to_utc(F.col("occurred_at")).alias("occurred_at"),
        dedup_key(F.col("dedup_key")).alias("dedup_key"),
        "ord",
    )


def reward_candidates(rows: DataFrame) -> DataFrame:
    return rows.select(
        "version_id",
        F.col("player_id").try_cast("bigint").alias("player_id"),
        "player_email",
        "reward_type",
        "reward_code",
        F.coalesce("status", F.lit("granted")).alias("status"),
        to_utc(F.col("granted_at")).alias("granted_at"),
        to_utc(F.col("redeemed_at")).alias("redeemed_at"),
        dedup_key(F.col("dedup_key")).alias("dedup_key"),
        "ord",
    )


def answer_candidates(rows: DataFrame) -> DataFrame:
    return rows.select(
        "version_id",
        F.col("player_id").try_cast("bigint").alias("player_id"),
        "player_email",
        F.col("question_id").try_cast("bigint").alias("question_id"),
        F.col("answer_option_id").try_cast("bigint").alias("answer_option_id"),
        "answer_text",
        to_utc(F.col("occurred_at")).alias("occurred_at"),
        "ord",
    )


def resolved_rows(candidates: DataFrame, players: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates of known players, carrying the resolved id. The others count as failed and
    never claim a dedup key."""
    resolved = resolve_players(candidates, players, users).where(F.col("resolved_id").isNotNull())
    return resolved.drop("player_id", "player_email").withColumnRenamed("resolved_id", "player_id")


def known_answers(
    candidates: DataFrame, questions: DataFrame, options: DataFrame
) -> DataFrame:
    """Answers whose question, and option if given, exist in the version."""
    flagged = flag_existing(candidates, questions, "question_id", "_question", "ord")
    flagged = flag_existing(flagged, options, "answer_option_id", "_option", "ord")
    ok = F.col("_question") & (F.col("answer_option_id").isNull() | F.col("_option"))
    return flagged.where(ok).drop("_question", "_option")


def with_ids(rows: DataFrame, first_id: int) -> DataFrame:
    """Ids follow the batch order. Dropped rows leave gaps; no global numbering is needed."""
    return rows.withColumn("id", (F.lit(first_id) + F.col("ord")).cast("bigint"))


# --- jobs -----------------------------------------------------------------------------------------


def ingest_events(job: Job, rows: DataFrame) -> Counters:
    candidates = event_candidates(rows)
    known = job.stage(job.identified(candidates), "known")
    fresh = new_rows(known, job.stored_keys("events", candidates), wanted=candidates)
    first_id = job.ids["events"]
    events = job.write(stored_events(fresh, first_id).withColumn("created_at", job.stamp()), "events")
    typed = F.when(F.col("type").isin(*job.registry.typed), F.col("type"))
    stored = events.agg(F.count(F.lit(1)).alias("n"), F.collect_set(typed).alias("typed")).first()
    inserted, skipped = stored["n"], 0
    if stored["typed"]:
        skipped = _write_typed(job, events, first_id, sorted(stored["typed"]))
    if inserted:
        job.write(event_sketches(events), "event_sketches")
    if job.settings.maintain_scores and (inserted or job.replaces is not None):
        _add_scores(job, events)
    processed, accepted = candidates.count(), known.count()
    return Counters(processed, inserted, accepted - inserted, processed - accepted, skipped)


def _write_typed(job: Job, events: DataFrame, first_event: int, event_types: list[str]) -> int:
    """Typed records of the stored events, projected in one pass that parses every payload once; each target then
    reads its own columns of the staged pass. Returns how many events were skipped."""
    references = {name: job.table(name) for name in job.registry.references.values()}
    projected = job.stage(project_all(events, references, job.registry), "typed")

    def write(event_type: str) -> None:
        rule = job.registry.typed[event_type]
        records = records_of(projected, event_type, job.registry).withColumn("ord", F.col("event_id") - first_event)
        if rule.unique:
            records = _first_of_key(job, records, rule.table, list(rule.unique))
        absent = {"dedup_key": "string", "redeemed_at": "timestamp"}
        records = records.withColumns(
            {c: F.lit(None).cast(t) for c, t in absent.items() if c not in records.columns}
        )
        if rule.unique:
            job.write(with_ids(records, job.ids[rule.table]), rule.table, f"-{event_type}")
        else:
            # Columns of the staged pass: nothing is left to compute, so they are not staged again.
            job.logged.append((with_ids(records, job.ids[rule.table]), rule.table))

    def write_skips() -> int:
        skips = skipped_records(projected)
        job.logged.append((skips, "typed_skipped"))
        return skips.count()

    with ThreadPoolExecutor(max_workers=4) as pool:
        skips = pool.submit(write_skips)
        list(pool.map(write, event_types))
        return skips.result()


def _first_of_key(job: Job, rows: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """First row for each key that is not stored yet; through the index where it holds that key."""
    if keys != ["version_id", *INDEXED_TABLES.get(table, [])]:
        return new_by_natural_key(rows, job.table(table), keys)
    keyed = rows.withColumn("dedup_key", natural_key(table))
    fresh = new_rows(keyed, job.stored_keys(table, keyed))
    return fresh if "dedup_key" in rows.columns else fresh.drop("dedup_key")


def _add_scores(job: Job, events: DataFrame) -> None:
    """The new events' scores on top of their players' totals. The changed players carry the batch's number like its
    events, so both are seen or neither, and a retry starts from the totals before. A replay adds the difference."""
    sums = score_rollup(events)
    if job.replaces is not None:
        before = score_rollup(job.store.rows_of_write("events", job.replaces, job.versions))
        both = sums.unionByName(before.withColumn("score", -F.col("score")))
        sums = both.groupBy("version_id", "player_id").agg(F.sum("score").alias("score"))
    gained = job.stage(sums.where("score <> 0").withColumnRenamed("player_id", "id"), "scores")
    if gained.limit(1).count() == 0:
        return
    keys = ["version_id", "id"]
    players = touched(job.table("players").drop("bucket"), gained, keys).join(gained, keys)
    total = (F.coalesce("total_score", F.lit(0)) + F.col("score")).cast("bigint")
    job.change(players.withColumns({"total_score": total, "updated_at": job.stamp()}).drop("score"), "players")


def _ingest_fact(job: Job, table: str, candidates: DataFrame, known: DataFrame) -> Counters:
    """`known` is resolved once: the copy that is staged feeds the count, the dedup and the write."""
    known = job.stage(known, "known")
    keyed = known if "dedup_key" in known.columns else known.withColumn("dedup_key", natural_key(table))
    fresh = new_rows(keyed, job.stored_keys(table, keyed), wanted=keyed)
    fresh = fresh.withColumns({"event_id": F.lit(None).cast("bigint"), "created_at": job.stamp()})
    inserted = job.write(with_ids(fresh.select(*[c for c in fresh.columns if c in known.columns or c != "dedup_key"]), job.ids[table]), table).count()
    processed, accepted = candidates.count(), known.count()
    return Counters(processed, inserted, accepted - inserted, processed - accepted)


def ingest_transactions(job: Job, rows: DataFrame) -> Counters:
    candidates = transaction_candidates(rows)
    # An amount that the column cannot hold fails its row, not the batch.
    return _ingest_fact(job, "transactions", candidates, job.identified(candidates).where(F.col("amount").isNotNull()))


def ingest_rewards(job: Job, rows: DataFrame) -> Counters:
    candidates = reward_candidates(rows)
    return _ingest_fact(job, "rewards", candidates, job.identified(candidates))


def ingest_answers(job: Job, rows: DataFrame) -> Counters:
    candidates = answer_candidates(rows)
    known = known_answers(job.identified(candidates), job.table("questions"), job.table("answer_options"))
    return _ingest_fact(job, "answers", candidates, known)


def ingest_players(job: Job, rows: DataFrame) -> Counters:
    """Users and players are merged with the rows of their keys, and only these are written."""
    store = job.store
    batch = rows.withColumn("registered_at", to_utc(F.col("registered_at")))
    accepted = job.stage(batch.join(external_id_clashes(batch, store.read("users", at=job.at)), "email", "left_anti"), "accepted")
    users = job.change(
        merge_users(
            store.matching("users", accepted.select("email"), at=job.at), collapse_users(accepted), job.ids["users"], job.stamp()
        ),
        "users",
    )
    mails = users.select(F.col("id").alias("user_id"), "email")
    # Staged, since the buckets, the existing rows and the merge all ask for it.
    collapsed = job.stage(collapse_players(accepted, job.settings.chunk_size).join(mails, "email"), "collapsed")
    existing = store.matching("players", collapsed.select("version_id", "user_id"), job.versions, job.at)
    players = job.change(merge_players(existing, collapsed, job.ids["players"], job.stamp()), "players")
    counted = player_counters(players).first()
    processed, kept = batch.count(), accepted.count()
    return Counters(processed, counted["inserted"], counted["duplicates"], processed - kept)


JOBS: Mapping[str, Callable[[Job, DataFrame], Counters]] = {
    "players": ingest_players,
    "events": ingest_events,
    "transactions": ingest_transactions,
    "answers": ingest_answers,
    "rewards": ingest_rewards,
}


def run_import(
    store: CampaignStore,
    batch_type: str,
    rows: DataFrame,
    import_id: str | None = None,
    mode: str = "reject_batch",
    settings: Settings = DEFAULT_SETTINGS,
    registry: Registry = DEFAULT_REGISTRY,
    rejected_documents: int = 0,
) -> Counters | None:
    """Ingest one batch (text rows with version_id and ord) and record it in the ledger.

    `reject_batch` refuses the whole batch when a row breaks the rules; `quarantine` keeps the
    good rows and stores the others with their errors. Returns None for a batch that is already
    completed. A failed batch may be run again, with the same rows or corrected ones: an attempt
    takes new ids and a new number, computes everything from the tables as they are, and becomes
    visible in all tables at once when its number is committed. The ids of an attempt are reserved in
    the ledger before it writes and are never given out again.
    """
    import_id = import_id or new_id()
    ledger = ImportLedger(store)
    with store.lock:
        recover(store)
        before = ledger.state(import_id)
        if before is not None and before["status"] == COMPLETED:
            return None
        raw = _land(store, batch_type, rows, import_id)
        seen = raw.agg(F.max("ord").alias("last"), F.collect_set("version_id").alias("versions")).first()
        versions = tuple(sorted(seen["versions"]))
        if settings.check_versions:
            require_live_versions(store, versions)
        attempts = (before["attempts"] if before else 0) + 1
        attempt = f"{import_id}/{attempts}"
        checked = _checked(store, raw, batch_type, attempt)
        good, bad = split_checked(checked)
        rejected = 0
        if mode == "reject_batch":
            try:
                refuse_unclean(checked, batch_type, settings.max_batch_rows)
            except BatchRejected:
                store.drop_stage(import_id)
                raise
        else:
            bad = bad.withColumn("import_id", F.lit(import_id))
            path = store.path(f"rejected/{batch_type}/{import_id}")
            bad.write.mode("overwrite").parquet(path)
            rejected = store.spark.read.schema(bad.schema).parquet(path).count()
        now = utc_now()
        first_ids = ledger.first_ids(WRITES[batch_type])
        size = 0 if seen["last"] is None else seen["last"] + 1
        number = store.begin(import_id)
        entry = {
            "type": batch_type,
            "batch_no": number,
            "batch_id": import_id,
            "attempts": attempts,
            "last_ids": {table: first + size - 1 for table, first in first_ids.items()},
            "created_at": before["created_at"] if before else now,
            "started_at": now,
        }
        ledger.write(import_id, status=PROCESSING, **entry)
        job = Job(store, import_id, attempt, now, first_ids, settings, registry, versions, number, store.snapshot())
        try:
            counters = JOBS[batch_type](job, good)
            job.publish()
            counters = replace(counters, rejected=rejected, rejected_documents=rejected_documents)
            store.commits.commit(number, outcome(counters))
        except Exception as error:
            ledger.write(import_id, status=FAILED, error_message=str(error), completed_at=utc_now(), **entry)
            raise
        ledger.write(import_id, status=COMPLETED, completed_at=utc_now(), **outcome(counters), **entry)
        store.drop_stage(import_id)
        store.tidy()
        return counters


def outcome(counters: Counters) -> dict[str, int]:
    """The counters as the ledger names them."""
    values = asdict(counters)
    return {"processed_rows": values.pop("processed"), **values}


def recover(store: CampaignStore) -> list[str]:
    """Settle the imports and swaps of a driver that died. An import that was committed is complete, whatever the
    ledger was told; the others are failed and may be run again. Each is settled once."""
    store.finish_swaps()
    ledger, lost = ImportLedger(store), []
    for state in ledger.unfinished():
        import_id = state.pop("import_id")
        kept = {k: v for k, v in state.items() if k not in ("status", "seq", "completed_at")}
        record = store.commits.done(state["batch_no"]) if state["batch_no"] is not None else None
        if record is not None:
            ledger.write(import_id, status=COMPLETED, completed_at=utc_now(), **{**kept, **record})
        else:
            ledger.write(import_id, status=FAILED, completed_at=utc_now(), **{**kept, "error_message": "the driver was lost"})
            lost.append(import_id)
        store.drop_stage(import_id)
    return lost


def replay(
    store: CampaignStore, import_id: str, settings: Settings = DEFAULT_SETTINGS, registry: Registry = DEFAULT_REGISTRY
) -> DataFrame:
    """Run a completed import again from its raw batch, under the rules and reference tables of today, in place of
    what it stored. Returns the difference: (stored, id, change) with `added`, `changed` or `removed` rows.

    Rows keep the ids that the import reserved. The new rows become visible and the old ones vanish by one commit; a
    replay that fails leaves the import as it was. Bad rows are quarantined. Rows that later imports left out as
    duplicates of a row that is removed now do not come back. Player batches overwrite fields in order of arrival and
    are not replayed.
    """
    with store.lock:
        recover(store)
        ledger = ImportLedger(store)
        before = ledger.state(import_id)
        if before is None or before["status"] != COMPLETED or before["type"] == "players":
            raise ValueError(f"no completed import of log rows {import_id}")
        batch_type, old = before["type"], store.commits.newest(before["batch_no"])
        raw = store.spark.read.parquet(store.path(f"raw/{batch_type}/{import_id}"))
        seen = raw.agg(F.max("ord").alias("last"), F.collect_set("version_id").alias("versions")).first()
        first_ids = {table: last - seen["last"] for table, last in before["last_ids"].items()}
        number = store.begin(import_id)
        attempt, now = f"{import_id}/replay-{number}", utc_now()
        job = Job(
            store, import_id, attempt, now, first_ids, settings, registry, tuple(sorted(seen["versions"])), number, store.snapshot().without(old), old
        )
        try:
            good, bad = split_checked(_checked(store, raw, batch_type, attempt))
            rejected = store.stage(bad.withColumn("import_id", F.lit(import_id)), "rejected", attempt)
            counters = replace(JOBS[batch_type](job, good), rejected=rejected.count())
            job.publish()
            difference = _difference(job)
            store.commits.commit(number, outcome(counters), old)
            rejected.write.mode("overwrite").parquet(store.path(f"rejected/{batch_type}/{import_id}"))
            kept = {k: v for k, v in before.items() if k not in ("import_id", "seq", *outcome(counters))}
            kept |= {"batch_no": number, "attempts": before["attempts"] + 1, "started_at": now, "completed_at": utc_now()}
            ledger.write(import_id, **outcome(counters), **kept)
        finally:
            store.drop_stage(import_id)
        store.tidy()
        return difference


def _difference(job: Job) -> DataFrame:
    """Rows that the replay adds, changes or removes, kept beside the import's other records."""
    store, parts = job.store, []
    for table in WRITES["events"]:
        fields = [c for c in schemas.TABLES[table].fieldNames() if c not in ("id", "created_at")]
        side = lambda number, name, table=table, fields=fields: store.rows_of_write(table, number, job.versions).select(
            "id", F.struct(*fields).alias(name)
        )
        both = side(job.replaces, "_old").join(side(job.number, "_new"), "id", "full")
        change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
        parts.append(both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(F.lit(table).alias("stored"), "id", change.alias("change")))
    path = store.path(f"replays/{job.batch_id}/{job.number}")
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(path)
    return store.spark.read.schema("stored string, id long, change string").parquet(path)


def run_documents(
    store: CampaignStore,
    batch_type: str,
    documents: DataFrame,
    import_id: str | None = None,
    mode: str = "reject_batch",
    settings: Settings = DEFAULT_SETTINGS,
    registry: Registry = DEFAULT_REGISTRY,
) -> Counters | None:
    """Ingest documents as one batch. Documents that cannot be read, are empty or name no live version
    refuse the batch, or, with `quarantine`, are stored with their reason and text and counted."""
    import_id = import_id or new_id()
    with store.lock:
        landed = _land(store, f"documents/{batch_type}", documents, import_id)
        versions = live_versions(store.read("versions")) if settings.check_versions else None
        good, bad = split_documents(landed, batch_type, versions, settings.max_batch_rows)
        path = store.path(f"rejected/documents/{batch_type}/{import_id}")
        bad = bad.withColumn("import_id", F.lit(import_id))
        bad.write.mode("overwrite").parquet(path)
        rejected = store.spark.read.schema(bad.schema).parquet(path)
        number = rejected.count()
        if number and mode == "reject_batch":
            reasons = rejected.groupBy("reason").count().orderBy("reason").collect()
            raise BatchRejected("documents refused: " + ", ".join(f"{r['count']} {r['reason']}" for r in reasons))
        rows = with_ordinal(explode_documents(good, batch_type))
        # The document limit is checked above; a load of many documents has none.
        load = replace(settings, max_batch_rows=None)
        return run_import(store, batch_type, rows, import_id, mode, load, registry, number)


def refresh_scores(store: CampaignStore, event_type: str = GAME_EVENT) -> int:
    """Write `total_score` of the players whose events say otherwise, as changes of these players only. Imports keep
    the totals; this is the audit that scans all events."""
    with store.lock:
        recover(store)
        name = f"scores-{new_id()}"
        at = store.snapshot()
        players = store.read("players", at=at).drop("bucket")
        wrong = score_mismatches(players, store.read("events", at=at), event_type)
        scores = wrong.select("version_id", F.col("player_id").alias("id"), "score")
        mended = players.join(scores, ["version_id", "id"]).withColumn("total_score", F.col("score")).drop("score")
        mended = store.stage(mended, "players", name)
        changed = mended.count()
        if changed:
            number = store.begin(name)
            store.write_changes(mended, "players", number)
            store.commits.commit(number, {"players": changed})
        store.drop_stage(name)
        store.tidy()
        return changed


def _land(store: CampaignStore, batch_type: str, rows: DataFrame, import_id: str) -> DataFrame:
    """Keep the batch as it came, for audit and replay; every later pass reads this copy."""
    path = store.path(f"raw/{batch_type}/{import_id}")
    rows.write.mode("overwrite").parquet(path)
    return store.spark.read.schema(rows.schema).parquet(path)


def _checked(store: CampaignStore, raw: DataFrame, batch_type: str, attempt: str) -> DataFrame:
    """The batch trimmed and with its errors, staged: a row is judged once, however often the job reads it."""
    asis = ("payload",)
    return store.stage(with_errors(trim_strings(raw, skip=asis), batch_type, asis), "checked", attempt)
