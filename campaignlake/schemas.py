"""Table schemas of the campaign model."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "SMALLINT": T.ShortType(),
    "BOOLEAN": T.BooleanType(),
    "STRING": T.StringType(),
    "TIMESTAMP": T.TimestampType(),
    "DECIMAL(12,2)": T.DecimalType(12, 2),
    "MAP<STRING,BIGINT>": T.MapType(T.StringType(), T.LongType()),
    "BINARY": T.BinaryType(),
}


def _schema(columns: str) -> T.StructType:
    """Schema of "name TYPE, name TYPE"; usable before a session exists."""
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Column names, types and closed value lists of the data model.
VERSIONS = _schema(
    "id BIGINT, uuid STRING, name STRING, client_name STRING, status STRING, starts_at TIMESTAMP, "
    "ends_at TIMESTAMP, config STRING, created_at TIMESTAMP, updated_at TIMESTAMP, deleted_at TIMESTAMP"
)
USERS = _schema(
    "id BIGINT, email STRING, external_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
PLAYERS = _schema(
    "id BIGINT, version_id BIGINT, user_id BIGINT, registered_at TIMESTAMP, total_score BIGINT, "
    "language STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
# The three payload_* columns are extracted once on write, so scans prune and push them down.
EVENTS = _schema(
    "id BIGINT, version_id BIGINT, player_id BIGINT, type STRING, occurred_at TIMESTAMP, payload STRING, "
    "dedup_key STRING, created_at TIMESTAMP, payload_language STRING, payload_utm_source STRING, "
    "payload_score INT"
)
QUESTIONS = _schema(
    "id BIGINT, version_id BIGINT, code STRING, text STRING, type STRING, position SMALLINT, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
ANSWER_OPTIONS = _schema(
    "id BIGINT, version_id BIGINT, question_id BIGINT, code STRING, label STRING, position SMALLINT, "
    "is_correct BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP"
)
ANSWERS = _schema(
    "id BIGINT, version_id BIGINT, player_id BIGINT, event_id BIGINT, question_id BIGINT, "
    "answer_option_id BIGINT, answer_text STRING, occurred_at TIMESTAMP, created_at TIMESTAMP"
)
TRANSACTIONS = _schema(
    "id BIGINT, version_id BIGINT, player_id BIGINT, event_id BIGINT, type STRING, amount DECIMAL(12,2), "
    "currency STRING, status STRING, external_ref STRING, dedup_key STRING, occurred_at TIMESTAMP, "
    "created_at TIMESTAMP"
)
REWARDS = _schema(
    "id BIGINT, version_id BIGINT, player_id BIGINT, event_id BIGINT, reward_type STRING, reward_code STRING, "
    "dedup_key STRING, status STRING, granted_at TIMESTAMP, redeemed_at TIMESTAMP, created_at TIMESTAMP"
)
IMPORT_LOG = _schema(
    "import_id STRING, type STRING, batch_id STRING, status STRING, attempts INT, processed_rows BIGINT, "
    "inserted BIGINT, duplicates BIGINT, failed BIGINT, skipped BIGINT, "
    "rejected BIGINT, rejected_documents BIGINT, last_ids MAP<STRING,BIGINT>, "
    "error_message STRING, created_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP, batch_no BIGINT, "
    "seq BIGINT"
)
# Events of a batch by version, type and day: how many, and a mergeable sketch of their players.
EVENT_SKETCHES = _schema("version_id BIGINT, type STRING, occurred_at TIMESTAMP, events BIGINT, players BINARY")
TYPED_SKIPPED = _schema("version_id BIGINT, event_id BIGINT, type STRING, reason STRING")
EXPORT_LOG = _schema(
    "export_id STRING, version_id BIGINT, params STRING, format STRING, status STRING, attempts INT, "
    "progress INT, total_rows BIGINT, processed_rows BIGINT, file_path STRING, file_size BIGINT, "
    "error_message STRING, created_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP, seq BIGINT"
)

TABLES = {
    "versions": VERSIONS,
    "users": USERS,
    "players": PLAYERS,
    "events": EVENTS,
    "questions": QUESTIONS,
    "answer_options": ANSWER_OPTIONS,
    "answers": ANSWERS,
    "transactions": TRANSACTIONS,
    "rewards": REWARDS,
    "typed_skipped": TYPED_SKIPPED,
    "event_sketches": EVENT_SKETCHES,
    "import_log": IMPORT_LOG,
    "export_log": EXPORT_LOG,
}

# Parent key of every child column: (child table, column) -> parent table.
RELATIONS = {
    ("players", "user_id"): "users",
    ("players", "version_id"): "versions",
    ("events", "player_id"): "players",
    ("events", "version_id"): "versions",
    ("questions", "version_id"): "versions",
    ("answer_options", "question_id"): "questions",
    ("answers", "version_id"): "versions",
    ("answers", "player_id"): "players",
    ("answers", "event_id"): "events",
    ("answers", "question_id"): "questions",
    ("answers", "answer_option_id"): "answer_options",
    ("transactions", "version_id"): "versions",
    ("transactions", "player_id"): "players",
    ("transactions", "event_id"): "events",
    ("rewards", "version_id"): "versions",
    ("rewards", "player_id"): "players",
    ("rewards", "event_id"): "events",
}

VERSION_STATUSES = ["draft", "active", "archived"]
TRANSACTION_TYPES = ["purchase", "spend", "refund"]
TRANSACTION_STATUSES = ["pending", "completed", "failed"]
REWARD_STATUSES = ["granted", "redeemed", "expired"]
