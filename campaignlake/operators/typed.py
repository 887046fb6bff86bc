"""Projection of events into typed records, driven by the registry's rules."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlake.functions.normalize import is_numeric, money
from campaignlake.functions.payload import payload_map
from campaignlake.operators.keys import flag_existing
from campaignlake.schemas import TABLES
from campaignlake.sources.registry import DEFAULT_REGISTRY, FieldRule, Registry, TypedRule

BASE = ["id", "version_id", "player_id", "occurred_at", "created_at", "type"]


def _key(key: str) -> Column:
    """A payload key's text; empty text counts as not given and is NULL, so that no later check asks for it again."""
    return F.nullif(F.col("_payload")[key], F.lit("")).alias(f"_v_{key}")


def _value(rule: FieldRule) -> Column:
    return F.col(f"_v_{rule.key}")


def _checks(rule: FieldRule) -> list[tuple[Column, Column]]:
    """(failing condition, reason) pairs of one field, in the order they are applied. A condition on a value that is not
    given is NULL and fails nothing."""
    value = _value(rule)
    checks: list[tuple[Column, Column]] = []
    if rule.required:
        checks.append((value.isNull(), F.lit(f"missing field '{rule.key}'")))
    if rule.one_of:
        checks.append((~value.isin(*rule.one_of), F.lit(f"invalid value for '{rule.key}'")))
    if rule.numeric:
        checks.append((~is_numeric(value), F.lit(f"non-numeric '{rule.key}'")))
    if rule.ref:
        reason = F.concat(F.lit(f"unknown {rule.ref} '"), value, F.lit("'"))
        checks.append((value.isNotNull() & ~F.col(f"_ok_{rule.key}"), reason))
    return checks


def _storage_checks(rule: FieldRule, table_type: str) -> list[tuple[Column, Column]]:
    """Values the typed column cannot hold are skipped instead of failing the batch."""
    value = _value(rule)
    if rule.max_length:
        return [(F.char_length(value) > rule.max_length, F.lit(f"too long '{rule.key}'"))]
    if table_type.startswith("decimal"):
        return [(value.isNotNull() & money(value).isNull(), F.lit(f"out of range '{rule.key}'"))]
    return []


def _first_reason(checks: list[tuple[Column, Column]]) -> Column:
    """Reason of the first failing check, NULL when all pass."""
    return _first_true(checks) if checks else F.lit(None).cast("string")


def _first_true(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, as one chain: small enough to be compiled as a whole."""
    return reduce(lambda chain, case: chain.when(*case), cases[1:], F.when(*cases[0]))


def _rule_columns(rule: TypedRule) -> tuple[list[Column], Column]:
    """A record's own columns, and why it is skipped, from the values and reference flags of its keys."""
    stored = {f.name: f.dataType.simpleString() for f in TABLES[rule.table].fields}
    checks = [c for f in rule.fields for c in _checks(f)]
    if rule.require_any:
        wanted = [f for f in rule.fields if f.key in rule.require_any]
        checks.append((F.coalesce(*[_value(f) for f in wanted]).isNull(), F.lit("require_any not satisfied")))
    checks += [c for f in rule.fields for c in _storage_checks(f, stored[f.column])]

    columns = []
    for f in rule.fields:
        value = _value(f)
        if f.column in rule.statics:
            value = F.coalesce(value, F.lit(rule.statics[f.column]))
        columns.append(value.try_cast(stored[f.column]).alias(f.column))
    mapped = {f.column for f in rule.fields}
    columns += [F.lit(v).alias(c) for c, v in rule.statics.items() if c not in mapped]
    return columns, _first_reason(checks)


def project_typed(
    events: DataFrame,
    event_type: str,
    tables: Mapping[str, DataFrame],
    registry: Registry = DEFAULT_REGISTRY,
) -> DataFrame:
    """Events of one type with their typed columns and `skip_reason` (NULL when projectable)."""
    rule: TypedRule = registry.typed[event_type]
    rows = events.where(F.col("type") == event_type).select(
        *BASE, payload_map(F.col("payload")).alias("_payload")
    )
    rows = rows.select(*BASE, *[_key(f.key) for f in rule.fields])
    for f in rule.fields:
        if f.ref:
            rows = flag_existing(
                rows.withColumn("_ref_id", _value(f).try_cast("bigint")),
                tables[registry.references[f.ref]],
                "_ref_id",
                f"_ok_{f.key}",
                row_id="id",
            ).drop("_ref_id")
    columns, reason = _rule_columns(rule)
    return rows.select(
        "version_id",
        "player_id",
        F.col("id").alias("event_id"),
        F.col("type").alias("event_type"),
        F.col("occurred_at").alias(rule.time_column),
        "created_at",
        *columns,
        reason.alias("skip_reason"),
    )


def project_all(
    events: DataFrame, tables: Mapping[str, DataFrame], registry: Registry = DEFAULT_REGISTRY
) -> DataFrame:
    """Events of all mapped types in one pass: the payload is parsed once, each reference is looked up once for all
    rules, and the row's own rule decides. `skip_reason` as in `project_typed`; the columns of the record are in the
    struct `to_<event type>`, so that whoever writes one target reads only its struct."""
    rules = registry.typed
    keys = sorted({f.key for rule in rules.values() for f in rule.fields})
    rows = events.where(F.col("type").isin(*rules)).select(*BASE, payload_map(F.col("payload")).alias("_payload"))
    rows = rows.select(*BASE, *[_key(k) for k in keys])
    for ref in sorted({f.ref for rule in rules.values() for f in rule.fields if f.ref}):
        asked = [(t, f) for t, rule in rules.items() for f in rule.fields if f.ref == ref]
        # A rule may name a reference by two keys; each key has its own lookup then.
        for n in range(max(sum(t == u for u, _ in asked) for t, _ in asked)):
            nth = {t: [f for u, f in asked if u == t][n] for t, _ in asked if sum(t == u for u, _ in asked) > n}
            wanted = F.coalesce(*[F.when(F.col("type") == t, _value(f).try_cast("bigint")) for t, f in nth.items()])
            found = flag_existing(rows.withColumn("_ref_id", wanted), tables[registry.references[ref]], "_ref_id", "_found", row_id="id")
            for t, f in nth.items():
                name = f"_ok_{f.key}"
                own = F.when(F.col("type") == t, F.col("_found"))
                found = found.withColumn(name, F.coalesce(own, F.col(name)) if name in found.columns else own)
            rows = found.drop("_ref_id", "_found")
    own = {t: _rule_columns(rule) for t, rule in rules.items()}
    reason = _first_true([(F.col("type") == t, reason) for t, (_, reason) in own.items()])
    records = [F.when(F.col("type") == t, F.struct(*columns)).alias(f"to_{t}") for t, (columns, _) in own.items()]
    return rows.select(
        "version_id", "player_id", F.col("id").alias("event_id"), F.col("type").alias("event_type"), "occurred_at", "created_at",
        *records, reason.alias("skip_reason"),
    )


def records_of(projected: DataFrame, event_type: str, registry: Registry = DEFAULT_REGISTRY) -> DataFrame:
    """The typed records of one event type in what `project_all` made."""
    own = projected.where((F.col("event_type") == event_type) & F.col("skip_reason").isNull())
    time = registry.typed[event_type].time_column
    return own.select("version_id", "player_id", "event_id", F.col("occurred_at").alias(time), "created_at", f"to_{event_type}.*")


def typed_records(projected: DataFrame) -> DataFrame:
    return projected.where(F.col("skip_reason").isNull()).drop("skip_reason", "event_type")


def skipped_records(projected: DataFrame) -> DataFrame:
    """Dead-letter rows: which event could not be projected and why."""
    return projected.where(F.col("skip_reason").isNotNull()).select(
        "version_id", "event_id", F.col("event_type").alias("type"), F.col("skip_reason").alias("reason")
    )
