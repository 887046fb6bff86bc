"""Declarative source registry: what a sheet may read, filter, aggregate and sort.

Adding a source is a registry entry; no other module changes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from campaignlake import schemas
from campaignlake.functions.payload import with_payload_columns
from campaignlake.functions.variants import PayloadPath, with_payload_paths


NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


@dataclass(frozen=True)
class FilterDef:
    column: str
    op: str


@dataclass(frozen=True)
class JoinDef:
    """Join to another table; `on` is a list of (left column, operator, right column).

    Declared joins go from the source to a table with one row per key. A hot key then sits on
    the left side, which AQE can split for inner and left joins alike. One condition at least is an
    equality, since a join of inequalities alone compares all pairs.
    """

    table: str
    alias: str
    on: tuple[tuple[str, str, str], ...]
    how: str = "inner"

    def __post_init__(self) -> None:
        if not any(op == "=" for _, op, _ in self.on):
            raise ValueError(f"the join to {self.table} needs an equality")


@dataclass(frozen=True)
class SourceDef:
    table: str
    fields: Mapping[str, str]
    default_columns: tuple[str, ...]
    filters: Mapping[str, FilterDef]
    aggregatable: Mapping[str, tuple[str, ...]]
    sort: tuple[str, ...]
    joins: tuple[JoinDef, ...] = ()
    version_column: str = "version_id"
    key: str = "id"
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df
    # Columns read out of the payload by path.
    paths: Mapping[str, PayloadPath] = field(default_factory=dict)

    def rows(self, table: DataFrame) -> DataFrame:
        """The table's rows with all columns that the source's fields name."""
        return with_payload_paths(self.prepare(table), self.paths)

    def with_path(self, alias: str, path: PayloadPath, sort: bool = False) -> "SourceDef":
        """A source that also knows `alias`: to select, group, filter (texts by a list, others by a value) and count,
        and with a numeric type to sum up."""
        if alias in self.fields:
            raise ValueError(f"the source has a field {alias}")
        column = f"payload_path_{len(self.paths)}"
        kind = path.type.lower()
        functions = ("count_distinct", *(("avg", "sum", "min", "max") if kind.startswith(NUMERIC_TYPES) else ()))
        allowed = {fn: (*self.aggregatable.get(fn, ()), alias) for fn in functions}
        return replace(
            self,
            fields={**self.fields, alias: column},
            filters={**self.filters, alias: FilterDef(column, "in" if kind == "string" else "eq")},
            aggregatable={**self.aggregatable, **allowed},
            sort=(*self.sort, alias) if sort else self.sort,
            paths={**self.paths, column: path},
        )


@dataclass(frozen=True)
class MetricDef:
    fn: str
    field: str | None = None


@dataclass(frozen=True)
class FieldRule:
    """How one payload key becomes one column of a typed record."""

    key: str
    column: str
    required: bool = False
    one_of: tuple[str, ...] = ()
    numeric: bool = False
    ref: str | None = None
    max_length: int | None = None


@dataclass(frozen=True)
class TypedRule:
    """Typed record that one event type also produces."""

    table: str
    time_column: str
    fields: tuple[FieldRule, ...]
    statics: Mapping[str, str] = field(default_factory=dict)
    require_any: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()


@dataclass(frozen=True)
class Registry:
    sources: Mapping[str, SourceDef]
    metrics: Mapping[str, MetricDef]
    source_by_name: Mapping[str, str]
    default_source: str
    typed: Mapping[str, TypedRule]
    references: Mapping[str, str]

    def with_source(self, name: str, source: SourceDef) -> "Registry":
        """A registry that also knows `name`."""
        return Registry(
            {**self.sources, name: source},
            self.metrics,
            self.source_by_name,
            self.default_source,
            self.typed,
            self.references,
        )

    def with_path(self, source: str, alias: str, path: str, type: str = "string", sort: bool = False) -> "Registry":
        """A registry whose `source`, one over a table with payloads, also knows a payload path under `alias`."""
        return self.with_source(source, self.sources[source].with_path(alias, PayloadPath(path, type), sort))


# Public aliases, whitelists, default columns and metric definitions.
EVENTS = SourceDef(
    table="events",
    prepare=with_payload_columns,
    fields={
        "id": "id",
        "type": "type",
        "occurred_at": "occurred_at",
        "player_id": "player_id",
        "language": "payload_language",
        "utm_source": "payload_utm_source",
        "score": "payload_score",
    },
    default_columns=("id", "type", "occurred_at", "language", "score"),
    filters={
        "type": FilterDef("type", "in"),
        "language": FilterDef("payload_language", "in"),
        "utm_source": FilterDef("payload_utm_source", "in"),
        "score": FilterDef("payload_score", "eq"),
        "occurred_from": FilterDef("occurred_at", "gte"),
        "occurred_to": FilterDef("occurred_at", "lte"),
    },
    aggregatable={
        "count": ("*",),
        "count_distinct": ("player_id", "type"),
        "avg": ("score",),
        "sum": ("score",),
        "min": ("score", "occurred_at"),
        "max": ("score", "occurred_at"),
    },
    sort=("id", "occurred_at", "score"),
)

PLAYERS = SourceDef(
    table="players",
    version_column="players.version_id",
    key="players.id",
    joins=(JoinDef("users", "users", (("users.id", "=", "players.user_id"),)),),
    fields={
        "player_id": "players.id",
        "email": "users.email",
        "registered_at": "players.registered_at",
        "total_score": "players.total_score",
        "language": "players.language",
    },
    default_columns=("player_id", "email", "registered_at", "total_score"),
    filters={"language": FilterDef("players.language", "in")},
    aggregatable={
        "count": ("*",),
        "count_distinct": ("player_id",),
        "sum": ("total_score",),
        "avg": ("total_score",),
    },
    sort=("player_id", "registered_at", "total_score"),
)

ANSWERS = SourceDef(
    table="answers",
    fields={
        "id": "id",
        "player_id": "player_id",
        "question_id": "question_id",
        "answer_option_id": "answer_option_id",
        "answer_text": "answer_text",
        "occurred_at": "occurred_at",
    },
    default_columns=("id", "player_id", "question_id", "answer_option_id", "answer_text", "occurred_at"),
    filters={
        "question_id": FilterDef("question_id", "in"),
        "answer_option_id": FilterDef("answer_option_id", "in"),
        "occurred_from": FilterDef("occurred_at", "gte"),
        "occurred_to": FilterDef("occurred_at", "lte"),
    },
    aggregatable={
        "count": ("*",),
        "count_distinct": ("player_id", "question_id", "answer_option_id"),
    },
    sort=("id", "occurred_at"),
)

TRANSACTIONS = SourceDef(
    table="transactions",
    fields={
        "id": "id",
        "player_id": "player_id",
        "type": "type",
        "amount": "amount",
        "currency": "currency",
        "status": "status",
        "external_ref": "external_ref",
        "occurred_at": "occurred_at",
    },
    default_columns=("id", "player_id", "type", "amount", "currency", "status", "occurred_at"),
    filters={
        "type": FilterDef("type", "in"),
        "status": FilterDef("status", "in"),
        "occurred_from": FilterDef("occurred_at", "gte"),
        "occurred_to": FilterDef("occurred_at", "lte"),
    },
    aggregatable={
        "count": ("*",),
        "count_distinct": ("player_id",),
        "sum": ("amount",),
        "avg": ("amount",),
        "min": ("amount",),
        "max": ("amount",),
    },
    sort=("id", "occurred_at", "amount"),
)

ANSWER_RECORD = TypedRule(
    table="answers",
    time_column="occurred_at",
    fields=(
        FieldRule("question_id", "question_id", required=True, ref="question"),
        FieldRule("answer_option_id", "answer_option_id", ref="answer_option"),
        FieldRule("answer_text", "answer_text", max_length=500),
    ),
    require_any=("answer_option_id", "answer_text"),
    unique=("version_id", "player_id", "question_id"),
)

TRANSACTION_RECORD = TypedRule(
    table="transactions",
    time_column="occurred_at",
    statics={"status": "completed"},
    fields=(
        FieldRule("type", "type", required=True, one_of=tuple(schemas.TRANSACTION_TYPES)),
        FieldRule("amount", "amount", required=True, numeric=True),
        FieldRule("currency", "currency", required=True, max_length=3),
        FieldRule("status", "status", one_of=tuple(schemas.TRANSACTION_STATUSES)),
        FieldRule("external_ref", "external_ref", max_length=100),
    ),
)

REWARD_RECORD = TypedRule(
    table="rewards",
    time_column="granted_at",
    statics={"status": "granted"},
    fields=(
        FieldRule("reward_type", "reward_type", required=True, max_length=40),
        FieldRule("reward_code", "reward_code", max_length=100),
    ),
)

DEFAULT_REGISTRY = Registry(
    sources={"events": EVENTS, "players": PLAYERS, "answers": ANSWERS, "transactions": TRANSACTIONS},
    metrics={
        "count": MetricDef("count"),
        "unique_players": MetricDef("count_distinct", "player_id"),
        "avg_score": MetricDef("avg", "score"),
    },
    source_by_name={
        "players": "players",
        "events_summary": "events",
        "answers": "answers",
        "transactions": "transactions",
    },
    default_source="events",
    typed={
        "answer_submitted": ANSWER_RECORD,
        "transaction": TRANSACTION_RECORD,
        "reward_granted": REWARD_RECORD,
    },
    references={"question": "questions", "answer_option": "answer_options"},
)
