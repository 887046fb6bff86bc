"""Spec guards: every rule is checked on the driver before any Spark job starts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from datetime import datetime
from typing import Any

from campaignlake.plans.spec import (
    DATE_FILTERS,
    FALSE_VALUES,
    TRUE_VALUES,
    SpecError,
    group_aliases,
    sort_entry,
    source_of,
    strip_alias,
)
from campaignlake.settings import DEFAULT_SETTINGS, Settings
from campaignlake.sources.registry import DEFAULT_REGISTRY, Registry, SourceDef

COUNT_ALL = "*"
# "xlsx" is accepted for compatibility and written as a workbook directory of CSV sheets.
FORMATS = ("xlsx", "csv", "parquet", "json")

Finding = tuple[str, str]


def is_date_text(value: Any) -> bool:
    try:
        datetime.fromisoformat(str(value).strip())
    except ValueError:
        return False
    return True


def _shape(params: Mapping[str, Any], settings: Settings, registry: Registry) -> Iterator[Finding]:
    fmt = params.get("format")
    if fmt is not None and fmt not in FORMATS:
        yield "format", f"Unknown format '{fmt}'."
    for name in DATE_FILTERS:
        if params.get(name) is not None and not is_date_text(params[name]):
            yield name, "Not a valid date."
    if params.get("include_summary") not in TRUE_VALUES + FALSE_VALUES:
        yield "include_summary", "Must be true or false."
    sheets = params.get("sheets")
    if sheets is None:
        return
    if not isinstance(sheets, (list, tuple)):
        yield "sheets", "Must be a list."
        return
    if len(sheets) > settings.max_sheets:
        yield "sheets", f"At most {settings.max_sheets} sheets are allowed."
    for i, sheet in enumerate(sheets):
        if not isinstance(sheet, Mapping):
            yield f"sheets.{i}", "Must be an object."
            continue
        name = sheet.get("name")
        if name is not None and (not isinstance(name, str) or len(name) > settings.max_sheet_name):
            yield f"sheets.{i}.name", f"Must be text of at most {settings.max_sheet_name} characters."
        if sheet.get("source") is not None and sheet["source"] not in registry.sources:
            yield f"sheets.{i}.source", f"Unknown source '{sheet['source']}'."
        for part in ("columns", "metrics", "group_by", "sort"):
            if sheet.get(part) is not None and not isinstance(sheet[part], (list, tuple)):
                yield f"sheets.{i}.{part}", "Must be a list."
        # An empty list is how some clients spell an empty object.
        if sheet.get("filters") not in (None, []) and not isinstance(sheet["filters"], Mapping):
            yield f"sheets.{i}.filters", "Must be an object."


def _aggregate(fn: str, target: str, source: SourceDef) -> Iterator[str]:
    if fn not in source.aggregatable:
        yield f"Unsupported aggregate '{fn}'."
    elif target not in source.aggregatable[fn]:
        yield f"Aggregate '{fn}' is not allowed on '{target}'."


def _sheet(sheet: Mapping[str, Any], source: SourceDef, registry: Registry) -> Iterator[Finding]:
    dims = group_aliases(sheet)
    plain: list[str] = []
    aggregated = bool(sheet.get("metrics"))
    for column in sheet.get("columns") or []:
        entry = column if isinstance(column, Mapping) else {"field": column}
        alias = strip_alias(entry["field"]) if entry.get("field") is not None else None
        if entry.get("fn") is not None:
            aggregated = True
            for message in _aggregate(str(entry["fn"]), alias or COUNT_ALL, source):
                yield "columns", message
            continue
        plain.append(alias or "")
        if (alias or "") not in source.fields:
            yield "columns", f"Unsupported field '{alias or ''}'."
    for name in sheet.get("metrics") or []:
        metric = registry.metrics.get(str(name))
        if metric is None:
            yield "metrics", f"Unsupported metric '{name}'."
        elif any(_aggregate(metric.fn, metric.field or COUNT_ALL, source)):
            yield "metrics", f"Metric '{name}' is not available on this source."
    for alias in dims:
        if alias not in source.fields:
            yield "group_by", f"Unsupported field '{alias}'."
    grouped = aggregated or bool(dims)
    if grouped:
        for alias in plain:
            if alias not in dims:
                yield "columns", f"Column '{alias}' must be in group_by when the sheet aggregates."
    for entry in sheet.get("sort") or []:
        column, direction = sort_entry(entry)
        if column not in source.sort:
            yield "sort", f"Unsupported sort column '{column}'."
        elif grouped and column not in dims:
            yield "sort", f"Sort column '{column}' must be in group_by when the sheet aggregates."
        if direction not in ("asc", "desc"):
            yield "sort", f"Unsupported sort direction '{direction}'."
    filters = sheet.get("filters")
    for key, value in (filters.items() if isinstance(filters, Mapping) else ()):
        alias = strip_alias(key)
        if alias not in source.filters:
            yield "filters", f"Unsupported filter '{alias}'."
        elif alias in DATE_FILTERS.values() and not is_date_text(value):
            yield f"filters.{alias}", f"Filter '{alias}' must be a valid date."


def check_spec(
    params: Mapping[str, Any],
    settings: Settings = DEFAULT_SETTINGS,
    registry: Registry = DEFAULT_REGISTRY,
) -> None:
    """Raise SpecError with every finding, or return quietly."""
    errors: dict[str, list[str]] = defaultdict(list)
    for path, message in _shape(params, settings, registry):
        errors[path].append(message)
    if not errors:
        for i, sheet in enumerate(params.get("sheets") or []):
            source = registry.sources.get(source_of(sheet, registry))
            if source is None:
                continue
            for part, message in _sheet(sheet, source, registry):
                errors[f"sheets.{i}.{part}"].append(message)
    if errors:
        raise SpecError(errors)
