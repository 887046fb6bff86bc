"""Dedup, merge and counters against plain Python on random batches with a hot key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from campaignlake.operators.dedup import last_wins, new_by_natural_key, new_rows
from campaignlake.operators.merge import collapse_players, merge_players, player_counters


def random_key(rng, keys):
    """A third of the rows share one key, some have none."""
    return rng.choice(["hot", None, rng.choice(keys)])


@pytest.mark.parametrize("seed", [1, 2])
def test_new_rows(spark, seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(40)]
    batch = [(rng.choice([1, 2]), random_key(rng, keys), ordinal) for ordinal in range(400)]
    rng.shuffle(batch)
    stored = {(rng.choice([1, 2]), rng.choice(keys)) for _ in range(20)}
    want, seen = [], set(stored)
    for version, key, ordinal in sorted(batch, key=lambda r: r[2]):
        if key is None or (version, key) not in seen:
            want.append(ordinal)
            seen.add((version, key))
    rows = spark.createDataFrame(batch, "version_id long, dedup_key string, ord long")
    existing = spark.createDataFrame([*stored, (1, None)], "version_id long, dedup_key string")
    got = new_rows(rows, existing)
    assert sorted(r.ord for r in got.collect()) == want
    natural = new_by_natural_key(rows.where("dedup_key is not null"), existing, ["version_id", "dedup_key"])
    keyed = {o for _, k, o in batch if k is not None}
    assert sorted(r.ord for r in natural.collect()) == [o for o in want if o in keyed]


@pytest.mark.parametrize("chunk", [7, 50])
def test_player_merge_and_counters(spark, chunk):
    rng = random.Random(chunk)
    mails = [f"m{i}" for i in range(30)]
    batch = [(1, random_key(rng, mails) or "hot", rng.choice(["it", None]), o) for o in range(200)]
    known = {m: i for i, m in enumerate(["hot", *mails[:10]], 1)}
    inserted = duplicates = 0
    present = set(known)
    for start in range(0, len(batch), chunk):
        users = {mail for _, mail, _, _ in batch[start : start + chunk]}
        inserted += len(users - present)
        duplicates += len(users & present)
        present |= users
    rows = spark.createDataFrame(batch, "version_id long, email string, language string, ord long")
    rows = rows.withColumn("registered_at", F.lit(None).cast("timestamp"))
    ids = {mail: n for n, mail in enumerate(["hot", *mails], 1)}
    users = spark.createDataFrame([(i, m) for m, i in ids.items()], "user_id long, email string")
    existing = spark.createDataFrame(
        [(i, 1, ids[m], None, 9, "de", None, None) for m, i in known.items()],
        "id long, version_id long, user_id long, registered_at timestamp, total_score int, language string, "
        "created_at timestamp, updated_at timestamp",
    )
    merged = merge_players(
        existing, collapse_players(rows, chunk).join(users, "email"), 1000, F.lit("2026-01-01").cast("timestamp")
    )
    assert tuple(player_counters(merged).first()) == (inserted, duplicates)
    last = {mail: language for _, mail, language, _ in batch}
    want = {ids[m]: (last.get(m, "de"), 9 if m in known else 0) for m in set(known) | set(last)}
    assert {r.user_id: (r.language, r.total_score) for r in merged.collect()} == want
    assert merged.select("id").distinct().count() == len(want)


def test_last_wins_keeps_nulls(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "y", 3)], "k string, v string, ord long")
    assert sorted((r.k, r.v) for r in last_wins(rows, ["k"]).collect()) == [("a", None), ("b", "y")]
