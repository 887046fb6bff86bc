"""Small builders shared by the tests."""

from __future__ import annotations

import json

from pyspark.sql import types as T

from campaignlake import schemas
from campaignlake.sources.batches import row_schema
from campaignlake.sources.tables import CampaignStore


def frame(spark, table, rows):
    """Rows given as dicts; missing columns are NULL."""
    schema = schemas.TABLES[table]
    return spark.createDataFrame([tuple(r.get(n) for n in schema.fieldNames()) for r in rows], schema)


def batch(spark, batch_type, rows, version_id=1):
    """Text rows as a batch document yields them."""
    schema = T.StructType(
        row_schema(batch_type).fields
        + [T.StructField("version_id", T.LongType()), T.StructField("ord", T.LongType())]
    )
    data = []
    for ordinal, row in enumerate(rows):
        text = {
            k: v if v is None or isinstance(v, str) else json.dumps(v) if isinstance(v, (dict, list)) else str(v)
            for k, v in row.items()
        }
        text.update(version_id=row.get("version_id", version_id), ord=ordinal)
        data.append(tuple(text.get(n) for n in schema.fieldNames()))
    return spark.createDataFrame(data, schema)


def seed(store: CampaignStore, table, rows):
    store.append(frame(store.spark, table, rows), table) if table in ("versions", "questions", "answer_options") else (
        store.write_batch(frame(store.spark, table, rows), table, "seed")
        if table in ("events", "answers", "transactions", "rewards")
        else store.replace_buckets(frame(store.spark, table, rows), table)
    )


def with_versions(store: CampaignStore):
    seed(store, "versions", [{"id": i, "uuid": f"u{i}", "name": f"V{i}"} for i in (1, 2)])


def with_players(store: CampaignStore, *names, version_id=1):
    """Users and players 1..n of a version, one per name; versions 1 and 2 are live."""
    with_versions(store)
    seed(store, "users", [{"id": i, "email": f"{n}@example.com"} for i, n in enumerate(names, 1)])
    seed(
        store,
        "players",
        [{"id": i, "version_id": version_id, "user_id": i, "total_score": 0} for i, _ in enumerate(names, 1)],
    )


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
