"""Row rules of the five batch types and of versions, as one projection per batch.

Input columns are text as read from JSON. Each rule yields (field, rule) entries in `errors`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlake import schemas
from campaignlake.functions.normalize import is_date, is_email, is_integer, is_numeric, trimmed
from campaignlake.functions.payload import is_json_container

Check = tuple[str, Callable[[Column], Column]]


@dataclass(frozen=True)
class RowRule:
    field: str
    required: bool = False
    checks: tuple[Check, ...] = ()


def max_chars(n: int) -> Check:
    return f"max:{n}", lambda c: F.char_length(c) <= n


def exact_chars(n: int) -> Check:
    return f"size:{n}", lambda c: F.char_length(c) == n


def one_of(values: list[str]) -> Check:
    return "in", lambda c: c.isin(*values)


INTEGER: Check = ("integer", is_integer)
NUMERIC: Check = ("numeric", is_numeric)
DATE: Check = ("date", is_date)
EMAIL: Check = ("email", is_email)
CONTAINER: Check = ("array", is_json_container)

# Limits and closed lists of the accepted rows.
_KEY = RowRule("dedup_key", checks=(max_chars(64),))
_PLAYER = (RowRule("player_id", True, (INTEGER,)), RowRule("player_email", checks=(EMAIL,)))
_WHEN = RowRule("occurred_at", True, (DATE,))

ROW_RULES: dict[str, tuple[RowRule, ...]] = {
    "players": (
        RowRule("email", True, (EMAIL,)),
        RowRule("external_id", checks=(max_chars(100),)),
        RowRule("registered_at", checks=(DATE,)),
        RowRule("language", checks=(max_chars(8),)),
    ),
    "events": (
        _KEY,
        *_PLAYER,
        RowRule("type", True, (max_chars(40),)),
        _WHEN,
        RowRule("payload", checks=(CONTAINER,)),
    ),
    "transactions": (
        _KEY,
        *_PLAYER,
        RowRule("type", True, (one_of(schemas.TRANSACTION_TYPES),)),
        RowRule("amount", True, (NUMERIC,)),
        RowRule("currency", True, (exact_chars(3),)),
        RowRule("status", checks=(one_of(schemas.TRANSACTION_STATUSES),)),
        RowRule("external_ref", checks=(max_chars(100),)),
        _WHEN,
    ),
    "answers": (
        *_PLAYER,
        RowRule("question_id", True, (INTEGER,)),
        RowRule("answer_option_id", checks=(INTEGER,)),
        RowRule("answer_text", checks=(max_chars(500),)),
        _WHEN,
    ),
    "rewards": (
        _KEY,
        *_PLAYER,
        RowRule("reward_type", True, (max_chars(40),)),
        RowRule("reward_code", checks=(max_chars(100),)),
        RowRule("status", checks=(one_of(schemas.REWARD_STATUSES),)),
        RowRule("granted_at", True, (DATE,)),
        RowRule("redeemed_at", checks=(DATE,)),
    ),
    "versions": (
        RowRule("name", True, (max_chars(150),)),
        RowRule("client_name", checks=(max_chars(150),)),
        RowRule("status", checks=(one_of(schemas.VERSION_STATUSES),)),
        RowRule("starts_at", checks=(DATE,)),
        RowRule("ends_at", checks=(DATE,)),
        RowRule("config", checks=(CONTAINER,)),
    ),
}


class BatchRejected(ValueError):
    """The batch holds rows that break the rules, or is too big or empty."""


def _error(field: str, rule: str, failing: Column) -> Column:
    return F.when(failing, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule")))


Failure = tuple[str, str, Column]


def _filled(value: Column) -> Column:
    return F.coalesce(trimmed(value) != "", F.lit(False))


def _cross_field(batch_type: str) -> list[Failure]:
    if batch_type == "answers":
        # "0" counts as empty, as any blank value does.
        given = [F.coalesce(~trimmed(F.col(c)).isin("", "0"), F.lit(False))
                 for c in ("answer_option_id", "answer_text")]
        return [("answer_option_id", "required_without:answer_text", ~(given[0] | given[1]))]
    if batch_type == "versions":
        start, end = (F.col(c).try_cast("timestamp") for c in ("starts_at", "ends_at"))
        return [("ends_at", "after_or_equal:starts_at", F.coalesce(end < start, F.lit(False)))]
    return []


def with_errors(rows: DataFrame, batch_type: str, untrimmed: Sequence[str] | None = None) -> DataFrame:
    """Add `errors`, an array of (field, rule); empty for a good row. The array's functions have no compiled form, so
    only a row that breaks a rule gets to them. `untrimmed` names the fields that may hold blanks (None: all); the
    others are null where they are empty, as `trim_strings` leaves them."""
    found: list[Failure] = []
    for rule in ROW_RULES[batch_type]:
        value = F.col(rule.field).cast("string") if rule.field in rows.columns else F.lit(None).cast("string")
        filled = _filled(value) if untrimmed is None or rule.field in untrimmed else value.isNotNull()
        if rule.required:
            found.append((rule.field, "required", ~filled))
        for name, ok in rule.checks:
            found.append((rule.field, name, filled & ~F.coalesce(ok(value), F.lit(False))))
    found += _cross_field(batch_type)
    bad = reduce(Column.__or__, [failing for _, _, failing in found])
    named = F.array_compact(F.array(*[_error(*failure) for failure in found]))
    return rows.withColumn("errors", F.when(bad, named).otherwise(F.array().cast("array<struct<field:string,rule:string>>")))


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their errors) of rows that have their errors."""
    clean = F.size("errors") == 0
    return checked.where(clean).drop("errors"), checked.where(~clean)


def split_valid(rows: DataFrame, batch_type: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their errors)."""
    return split_checked(with_errors(rows, batch_type))


def refuse_unclean(checked: DataFrame, batch_type: str, max_rows: int | None = None) -> None:
    """Reject the whole batch when it is empty, too big or has any bad row. One aggregate pass."""
    seen = checked.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") > 0).alias("bad")
    ).first()
    if seen["rows"] == 0:
        raise BatchRejected("the batch is empty")
    if max_rows is not None and seen["rows"] > max_rows:
        raise BatchRejected(f"the batch has {seen['rows']} rows, at most {max_rows} are allowed")
    if seen["bad"]:
        raise BatchRejected(f"{seen['bad']} of {seen['rows']} rows break the {batch_type} rules")


def require_clean(rows: DataFrame, batch_type: str, max_rows: int | None = None) -> None:
    """`refuse_unclean` for rows without their errors."""
    refuse_unclean(with_errors(rows, batch_type), batch_type, max_rows)
